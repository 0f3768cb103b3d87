"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over whole texts.

Every benchmark item gives its windows of ``WINDOW`` consecutive words (an item of fewer words is one window).
A slice of at most about ``SLICE`` (window, item) rows becomes one broadcast set: a vocabulary of its words, a
sorted array of window hashes for each window length, and the windows' word numbers.  A scan turns a batch of texts
into word numbers, rolls a hash over them, looks hashes up and compares the word numbers of what it finds, so only true
occurrences count.  A larger benchmark is cut into several slices, whose scans follow each other in one stage,
so what is broadcast stays bounded and no case is left out.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import free_name
from rasterloom.session import materialize

WINDOW = 10  # words
SLICE = 200_000  # (window, item) rows of one broadcast set
BITS = 22  # of a hash that index the first filter
BASE = np.uint64(0x9E3779B97F4A7C15)
BORDER = b"\x01"  # stands between texts; no word, since a word has no control character
#: Bytes of words are digits, letters and all above 0x7F; A-Z become a-z and the rest separates.
FOLDED = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))

SPAN = T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLDED).split()


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, item): the distinct windows of every item, words joined by a space, the item's id as text."""
    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = words_of(text)
                n = min(window, len(held))
                starts = len(held) - n + 1 if held else 0
                for lo in range(0, starts, 1 << 15):
                    made = [b" ".join(held[i:i + n]).decode() for i in range(lo, min(starts, lo + (1 << 15)))]
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array([item] * len(made), pa.string())], names=["words", "item"])

    named = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    return named.mapInArrow(cut, "words string, item string").distinct()


class Needles:
    """The windows of one slice, ready to be found in batches of texts."""

    def __init__(self, pairs: list[tuple[str, str]]):
        pairs = sorted(pairs)
        self.items = sorted({item for _, item in pairs})
        number = {item: i for i, item in enumerate(self.items)}
        texts, starts = [], []
        for at, (words, _) in enumerate(pairs):
            if not texts or texts[-1] != words:
                texts.append(words)
                starts.append(at)
        owner = np.array([number[item] for _, item in pairs], np.int64)
        held = [t.encode().split() for t in texts]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ws in held for w in ws}), 1)}
        self.mark = self.vocabulary[BORDER] = len(self.vocabulary) + 1
        bounds = np.array([*starts, len(pairs)])
        self.sets = {}  # length -> (hashes, word numbers, first and last place among the owners, owners)
        seed = 0
        while not self._laid_out(held, bounds, owner, seed):
            seed += 1

    def _laid_out(self, held, bounds, owner, seed: int) -> bool:
        """Hash tables without two windows of one hash; False if ``seed`` gives such two."""
        self.noise = np.random.default_rng([17, seed]).integers(0, 1 << 63, self.mark + 1, dtype=np.int64).astype(np.uint64)
        size = np.array([len(ws) for ws in held], np.int64)
        for n in np.unique(size).tolist():
            at = np.nonzero(size == n)[0]
            rows = np.array([[self.vocabulary[w] for w in held[i]] for i in at], np.int32).reshape(len(at), n)
            h = self.rolled(rows.reshape(-1), n)[::n]
            order = np.argsort(h)
            h = h[order]
            if (h[1:] == h[:-1]).any():
                return False
            first = np.zeros(1 << BITS, bool)
            first[(h >> np.uint64(64 - BITS)).astype(np.int64)] = True
            self.sets[n] = (first, h, rows[order], bounds[:-1][at[order]], bounds[1:][at[order]])
        self.owner = owner
        return True

    def rolled(self, ids: np.ndarray, n: int, before: np.ndarray | None = None, done: int = 0) -> np.ndarray:
        """Hashes of all stretches of ``n`` numbers; ``before`` are those of ``done`` numbers."""
        noise = self.noise[ids]
        size = max(0, len(ids) - n + 1)
        h = np.zeros(size, np.uint64) if before is None else before[:size].copy()
        for k in range(done, n):
            h *= BASE
            h += noise[k:k + size]
        return h

    def find(self, texts: list[str | None]):
        """(words per text, [(text, first word, length, item numbers)]) of a batch of texts."""
        parts = (b" " + BORDER + b" ").join([(t or "").encode().translate(FOLDED) for t in texts]).split()
        ids = np.fromiter(map(self.vocabulary.get, parts, repeat(0)), np.int32, len(parts))
        border = np.nonzero(ids == self.mark)[0]
        begin = np.concatenate([[0], border + 1])
        n_words = np.diff(np.concatenate([begin, [len(ids) + 1]])) - 1
        found, h, done = [], None, 0
        for n in sorted(self.sets):
            first, hashes, rows, lo, hi = self.sets[n]
            h = self.rolled(ids, n, h, done)
            done = n
            at = np.nonzero(first[(h >> np.uint64(64 - BITS)).astype(np.int64)])[0]
            place = np.searchsorted(hashes, h[at])
            at, place = at[place < len(hashes)], place[place < len(hashes)]
            same = hashes[place] == h[at]
            at, place = at[same], place[same]
            true = (ids[at[:, None] + np.arange(n)] == rows[place]).all(1)
            at, place = at[true], place[true]
            text = np.searchsorted(begin, at, side="right") - 1
            found += zip(text.tolist(), (at - begin[text]).tolist(), repeat(n), lo[place].tolist(), hi[place].tolist())
        return n_words, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order; touching ones become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _slices(spark, items: DataFrame, window: int, limit: int):
    """Broadcast sets of at most about ``limit`` rows that together hold all windows of ``items``."""
    held = materialize(windows(items, window), "windows")
    n = max(1, -(-held.count() // limit))
    for part in range(n):
        rows = held if n == 1 else held.filter(F.pmod(F.xxhash64("words", "item"), F.lit(n)) == part)
        got = rows.toArrow()  # about ``limit`` rows
        yield spark.sparkContext.broadcast(Needles(list(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))))


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = SLICE, text: str = "text",
         names: tuple[str, str, str] = ("n_words", "spans", "item_ids")) -> DataFrame:
    """``docs`` with its word count, the spans of words hit by any window, and the ids of the items they come from.

    Spans are [start, end) in words from 0, disjoint and in order; ids are texts, distinct and sorted.  A null
    text has no words.  Items without an id or without words give no window; items that repeat an id give the windows of all their
    rows; a window of several items counts for each.  ``docs`` keeps all columns and rows, repeated ones too; ``names`` must not
    clash with them.
    """
    at = docs.columns.index(text)
    plain = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(SPAN)),
                          T.StructField(names[2], T.ArrayType(T.StringType()))])
    out = docs
    for k, needles in enumerate(_slices(docs.sparkSession, items, window, limit)):
        def run(batches, needles=needles, again=k > 0):
            import pyarrow as pa

            kind = pa.list_(pa.struct([pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False)]))
            for batch in batches:
                n_words, found = needles.value.find(batch.column(at).to_pylist())
                rows = batch.num_rows
                spans = [[(s["start"], s["end"]) for s in v] for v in batch.column(batch.num_columns - 2).to_pylist()] if again else [[] for _ in range(rows)]
                names_of = [set(v) for v in batch.column(batch.num_columns - 1).to_pylist()] if again else [()] * rows
                for t, start, n, lo, hi in found:
                    spans[t].append((start, start + n))
                    names_of[t] = {*names_of[t], *(needles.value.items[i] for i in needles.value.owner[lo:hi].tolist())}
                made = [pa.array(n_words, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in merged(s)] for s in spans], kind),
                        pa.array([sorted(v) for v in names_of], pa.list_(pa.string()))]
                kept = batch.columns[:-3] if again else batch.columns
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[f.name for f in plain.fields])

        out = out.mapInArrow(run, plain)
    return out


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``."""
    got = scan(docs.select("doc_id", "text"), items, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"]))
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the bytes from each span's first word to its last."""
    raw = text.encode()
    inside = np.frombuffer(raw.translate(FOLDED), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    kept, at = [], 0
    for first, last in spans:
        kept.append(raw[at:starts[first]])
        at = ends[last - 1]
    return b"".join([*kept, raw[at:]]).decode()


def cleaned(docs: DataFrame, items: DataFrame, mode: str = "spans", **options) -> DataFrame:
    """``docs`` without benchmark passages: their words cut out of the texts (``spans``), or their documents left out (``documents``).

    Clean rows, null and empty texts stay as they are; n_chars follows a cut text where it is a column.
    """
    if mode not in ("spans", "documents"):
        raise ValueError("mode must be spans or documents")
    names = tuple(free_name(docs, c) for c in ("n_words", "spans", "item_ids"))
    got = scan(docs, items, names=names, **options)
    if mode == "documents":
        return got.filter(F.size(names[1]) == 0).select(*docs.columns)
    at, kept, header = docs.columns.index("text"), len(docs.columns), [*docs.columns, names[1]]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(kept + 1).to_pylist()
            new = [without_spans(t, [(s["start"], s["end"]) for s in v]) if v else t for t, v in zip(texts, spans)]
            columns = list(batch.columns[:kept])
            columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, batch.column(kept + 1)], names=header)

    out = got.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[1], T.ArrayType(SPAN))]))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(names[1]) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS n, array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM bw) AS s, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, g)),
cover AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) AS t(k) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM hit) AS x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN names USING (r)
"""
