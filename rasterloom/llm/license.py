"""License scans by template markup compiled to token automata.

A template is a run of words in which ``[[ ... ]]`` encloses an optional region and ``{{n}}`` stands for
one to n words of any wording.  The rest is mandatory: the automaton accepts a place in a
text only if those words match exactly.  States are bits of one integer, so all places of a template are
followed at once and a word costs a few integer operations where the template is live.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import add_columns

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases whose places are counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public license notices as templates, and their labels.
TEMPLATES = {
    "mit": (
        "released [[and distributed]] under the [[terms of the]] mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "apache-2.0": ("licensed under the apache license [[version]] 2 0",),
    "gpl-3.0": (
        "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[of the license]]",
        "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3",
    ),
    "gpl-2.0": (
        "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[of the license]]",
        "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2",
    ),
    "cc-by-nc-4.0": ("licensed under [[a]] [[the]] [[creative commons]] cc by nc 4 0",),
    "cc-by-4.0": ("licensed under [[a]] [[the]] [[creative commons]] cc by 4 0",),
    "cc-by-sa-4.0": ("licensed under [[a]] [[the]] [[creative commons]] cc by sa 4 0",),
    "isc": ("permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies",),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "copyright": ("copyright [[c]] {{6}} all rights reserved",),
}


@dataclass(frozen=True)
class Automaton:
    """Word automaton over bit states 0..n; state 0 is before the first word, the last one accepts."""

    label: str
    first: tuple[bytes, ...]  # words that can begin a match
    anchor: bytes  # a mandatory word, its longest; texts without it hold no match
    steps: dict[bytes, int]  # word -> states whose next word it is
    free: int  # states whose next word is any word
    opens: tuple[tuple[int, int], ...]  # (state, states reached from it without a word)
    accept: int

    def settle(self, states: int) -> int:
        """``states`` with all that they reach without a word; openings are in rising order."""
        for state, more in self.opens:
            if states >> state & 1:
                states |= more
        return states

    def longest(self, words: list[bytes], start: int) -> int:
        """Past the last word of the longest match that begins at ``start``; 0 if there is none."""
        states, best, at = self.settle(1), 0, start
        while states and at < len(words):
            states = self.settle((states & (self.steps.get(words[at], 0) | self.free)) << 1)
            at += 1
            if states >> self.accept & 1:
                best = at
        return best


def compile_template(label: str, markup: str) -> Automaton:
    """Compiles the markup; optional regions do not nest."""
    slots: list[bytes | None] = []
    opens: list[tuple[int, int]] = []
    region = None
    for token in markup.replace("[[", " [[ ").replace("]]", " ]] ").split():
        if token == "[[":
            region = len(slots)
        elif token == "]]":
            opens.append((region, len(slots)))
            region = None
        elif token.startswith("{{"):
            n = int(token.strip("{}"))
            # one word at least; after each further one the rest of the slot may be passed over
            opens += [(len(slots) + i, len(slots) + n) for i in range(1, n)]
            slots += [None] * n
        else:
            slots.append(token.encode())
    steps: dict[bytes, int] = {}
    for i, word in enumerate(slots):
        if word is not None:
            steps[word] = steps.get(word, 0) | 1 << i
    free = sum(1 << i for i, word in enumerate(slots) if word is None)
    inside = {i for a, b in opens for i in range(a, b)}
    mandatory = [w for i, w in enumerate(slots) if w is not None and i not in inside]
    skips = tuple(sorted((a, 1 << b) for a, b in opens))
    made = Automaton(label, (), max(mandatory, key=len), steps, free, skips, len(slots))
    begin = made.settle(1)
    if begin & free:
        raise ValueError("a template may not begin with any word")
    return Automaton(label, tuple(w for w, at in steps.items() if at & begin), made.anchor, steps, free, skips, len(slots))


AUTOMATA = tuple(compile_template(label, markup) for label, group in TEMPLATES.items() for markup in group)


def phrase_places(words: list[bytes], lowered: bytes) -> list[tuple[int, int, str]]:
    """(start, past the end, label) of every place of a base phrase."""
    out = []
    for phrase, label in PHRASES.items():
        parts = [p.encode() for p in phrase.split()]
        if not all(p in lowered for p in parts):
            continue
        at = -1
        try:
            while True:
                at = words.index(parts[0], at + 1)
                if words[at:at + len(parts)] == parts:
                    out.append((at, at + len(parts), label))
        except ValueError:
            pass
    return out


def template_places(words: list[bytes], lowered: bytes) -> list[tuple[int, int, str]]:
    """(start, past the end, label) of the longest template match at every start."""
    out = []
    for a in AUTOMATA:
        if a.anchor not in lowered:
            continue
        for word in a.first:
            at = -1
            try:
                while True:
                    at = words.index(word, at + 1)
                    stop = a.longest(words, at)
                    if stop:
                        out.append((at, stop, a.label))
            except ValueError:
                pass
    return out


def scan_text(text: str | None) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Number of words, base places and template places of a whole text; a null text is empty."""
    lowered = (text or "").encode("utf-8", "surrogatepass").lower()
    words = WORD.findall(lowered)
    return len(words), phrase_places(words, lowered), template_places(words, lowered)


PLACES = "array<struct<start: bigint, stop: bigint, label: string>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base, matched): all phrase places and all template places of every text, in order.

    Rows are independent; null and empty texts have no words.  Only doc_id and text are read.
    """
    def run(texts):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string())]))
        n, base, more = [], [], []
        for text in texts:
            count, phrases, templates = scan_text(text)
            n.append(count)
            base.append([dict(zip(("start", "stop", "label"), p)) for p in sorted(phrases)])
            more.append([dict(zip(("start", "stop", "label"), p)) for p in sorted(templates)])
        return [pa.array(n, pa.int64()), pa.array(base, kind), pa.array(more, kind)]

    fields = T.StructType.fromDDL(f"n_words bigint, base {PLACES}, matched {PLACES}").fields
    return add_columns(docs.select("doc_id", "text"), "text", run, fields).select("doc_id", "n_words", "base", "matched")


def summary(found: DataFrame) -> DataFrame:
    """Digest of ``scan``: counts, first and last base place, labels, and the share of words inside places."""
    names = lambda *cols: F.array_join(F.sort_array(F.array_distinct(F.concat(*[F.transform(c, lambda p: p["label"]) for c in cols]))), ",")
    starts = F.transform("base", lambda p: p["start"])
    inside = F.aggregate(F.concat("base", "matched"), F.lit(0).cast("bigint"), lambda n, p: n + p["stop"] - p["start"])
    share = F.when(F.col("n_words") > 0, F.least(F.lit(1.0), inside / F.col("n_words"))).otherwise(F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names("base").alias("base_labels"), names("base", "matched").alias("labels"), share.alias("score"))
