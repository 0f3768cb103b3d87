"""Decontamination against a scan by regular expression, whatever the slices."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import decontam
from rasterloom.llm.common import prepare

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=10):
    held = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            k = min(n, len(w))
            held.setdefault(str(item), set()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for item, ws in held.items():
            for one in ws:
                for i in range(len(w) - len(one) + 1):
                    if tuple(w[i:i + len(one)]) == one:
                        hit.update(range(i, i + len(one)))
                        names.add(item)
        yield doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


ITEMS = [(7, PASSAGE), (10, "x " + PASSAGE.upper()), (2, "Über-straße 42"), (2, "lone"), (None, "never seen here"), (3, None), (4, ""), (5, " ,.; "), (6, "a a a a a a a a a a a"),
         (8, PASSAGE), (8, PASSAGE)]
DOCS = [(1, "Say: one, two THREE four five six seven eight nine ten. Then."), (2, None), (3, ""), (4, "one two three"), (5, PASSAGE * 2), (5, PASSAGE), (6, "ÜBER straße 42 über-straße-42"),
        (7, "über straße 42\nlone wolf"), (8, "a " * 40), (9, "never seen here"), (10, "one two three four five six seven eight nine. ten\x00eleven;twelve"), (11, "   \n\t"),
        (12, "é" * 50 + " lone\x01lone"), (None, "Lone"), (13, "eleven twelve one two three four five six seven eight nine ten eleven")]


@pytest.fixture(scope="module")
def tables(spark):
    prepare(spark)
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("spans", "n_words", "item_ids", "words", "n_chars")}).repartition(3)
    return docs, spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("words", F.lit(1))


@pytest.mark.parametrize("limit", [decontam.SLICE, 3])
def test_report(tables, limit):
    docs, items = tables
    got = decontam.report(docs, items, limit=limit).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(DOCS, ITEMS), key=str)


def test_spans_and_documents_leave(spark, tables):
    docs, items = tables
    got = {r.doc_id: r for r in decontam.cleaned(docs.filter("doc_id <> 5"), items).collect()}
    assert got[1].text == "Say: . Then." and got[7].text == "über straße 42\n wolf" and got[9].text == "never seen here" and got[2].text is None and got[3].text == ""
    assert got[1].words == "x" and len(got) == len(DOCS) - 3
    kept = [r.doc_id for r in decontam.cleaned(docs, items, mode="documents").collect()]
    assert sorted(kept) == [2, 3, 4, 9, 11]
    again = decontam.cleaned(docs.select("doc_id", "text", F.length("text").alias("n_chars")), items)
    assert again.filter("n_chars <> length(text)").count() == 0


def test_empty_tables(tables):
    docs, items = tables
    assert decontam.report(docs.limit(0), items).count() == 0
    rows = decontam.report(docs, items.limit(0)).collect()
    assert len(rows) == len(DOCS) and not any(r.contaminated or r.n_hit or r.n_items for r in rows)


def test_megabytes_of_text(spark):
    prepare(spark)
    text = "filler words " * 400_000 + PASSAGE + " tail" * 200_000
    got = decontam.report(spark.createDataFrame([(1, text), (2, PASSAGE[4:])], "doc_id bigint, text string"), spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in got.collect()) == [(1, 1_000_012, 12), (2, 11, 11)]


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontam, "BASE", decontam.np.uint64(1))  # a sum: orders of the same words share a hash
    n_words, found = decontam.Needles([("b a c", "1")]).find(["a b c b a c", "c a b"])
    assert n_words.tolist() == [6, 3] and [(t, s, n) for t, s, n, *_ in found] == [(0, 3, 3)]
