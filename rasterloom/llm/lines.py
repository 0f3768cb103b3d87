"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines nominates, for each of several seeds, places where a chunk
starts and places where one ends; a chunk runs from a start to the next end.  Both borders are decided by lines
inside the chunk, so what stands around a passage moves none of its chunks.  A line of more than ``LONG_WORDS`` words
is a chunk of its own as well.  Chunks that occur elsewhere are removed after their bytes were compared, all but the
first occurrence in (doc_id, place) order.

A two-line passage is a chunk under one seed with probability 3/8, so under one of eight with 0.977; longer passages
are covered by the chunks inside them.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import add_columns
from rasterloom.session import materialize

SEEDS = 8  # chunkings; each reads three bits of the rolling hash
FACTOR = 31  # of the earlier line's hash in the rolling hash
LINE_HASH_DIGITS = 8  # hexadecimal digits of md5 that make a line's hash
LONG_WORDS = 50  # a single line of more words is a chunk
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def chunks_of(lines: list[bytes]) -> list[tuple[int, int]]:
    """Distinct chunks of all chunkings as (first line, past the last line), sorted; chunks without a word are left out."""
    import hashlib

    found = {(i, i + 1) for i, x in enumerate(lines) if len(x) > 2 * LONG_WORDS and len(WORD.findall(x)) > LONG_WORDS}
    if len(lines) > 1:
        hashes = np.array([int(hashlib.md5(x).hexdigest()[:LINE_HASH_DIGITS], 16) for x in lines], np.int64)
        rolled = FACTOR * hashes[:-1] + hashes[1:]
        words = np.concatenate([[0], np.cumsum([bool(x.strip(b" \t\n\v\f\r")) for x in lines])])
        for seed in range(SEEDS):
            bits = rolled >> (3 * seed)
            starts, ends = np.nonzero(bits & 1 == 0)[0], np.nonzero(bits >> 1 & 3 != 0)[0]
            at = np.searchsorted(ends, starts)
            starts, at = starts[at < len(ends)], at[at < len(ends)]
            past = ends[at] + 2
            real = words[past] > words[starts]
            found.update(zip(starts[real].tolist(), past[real].tolist()))
    return sorted(found)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _starts(lines: list[bytes]) -> list[int]:
    """Byte offset of every line, and the offset past the last line and its line feed."""
    return np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])]).tolist()


def _marks(docs: DataFrame) -> DataFrame:
    """(doc_id, version, a, b, mark) of every chunk; mark is a 64-bit hash of its bytes."""
    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            rows, firsts, pasts, marks = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                data = _bytes(text or "")
                lines = data.split(b"\n")
                at = _starts(lines)
                for a, b in chunks_of(lines):
                    rows.append(i)
                    firsts.append(a)
                    pasts.append(b)
                    marks.append(xxhash.xxh64_intdigest(data[at[a]:at[b] - 1], 9))
            of = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array(firsts, pa.int32()), pa.array(pasts, pa.int32()),
                 pa.array(np.array(marks, "<u8").view("<i8"))], names=["doc_id", "version", "a", "b", "mark"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("version bigint, a int, b int, mark bigint").fields])
    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(run, schema)


def _bodies(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunks`` with their bytes as column body; documents without any are not read further than the join."""
    per = chunks.groupBy("doc_id", "version").agg(F.collect_set(F.struct("a", "b", "mark")).alias("_chunks"))
    per = per.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "_chunks")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    joined = keyed.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))).select("doc_id", "version", "text", "_chunks")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, cut, bodies = [], [], []
            for i, (text, chunks) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                data = _bytes(text)
                at = _starts(data.split(b"\n"))
                for c in chunks:
                    rows.append(i)
                    cut.append((c["a"], c["b"], c["mark"]))
                    bodies.append(data[at[c["a"]]:at[c["b"]] - 1])
            of = pa.array(rows, pa.int32())
            a, b, marks = zip(*cut) if cut else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(a, pa.int32()), pa.array(b, pa.int32()),
                                              pa.array(marks, pa.int64()), pa.array(bodies, pa.binary())], names=["doc_id", "version", "a", "b", "mark", "body"])

    return joined.mapInArrow(run, T.StructType([*chunks.schema.fields, T.StructField("body", T.BinaryType())]))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, version, seen: chunks (a, b, n, kept)) of documents with chunks that occur n > 1 times; kept marks first occurrences.

    Hashes are counted first; bytes are fetched only for those that occur twice.  A hash whose chunks are all byte-equal
    decides by hash alone; chunks whose hashes collide are told apart by their bytes.
    """
    marks = materialize(_marks(docs), "marks")
    often = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark")
    chunks = materialize(marks.join(often, "mark").select(*marks.columns), "often")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "version", "a")
    bodies = _bodies(docs, chunks)
    same = materialize(bodies.groupBy("mark", "body").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")), "bodies")
    by_mark = same.groupBy("mark").agg(F.count(F.lit(1)).alias("bodies"), F.first("n").alias("n"), F.first("first").alias("first"))
    by_mark = materialize(by_mark.filter("bodies > 1 or n > 1"), "repeated")
    columns = ["doc_id", "version", "a", "b", "n", (place == F.col("first")).alias("kept")]
    seen = chunks.join(by_mark.filter("bodies = 1"), "mark").select(*columns)
    mixed = by_mark.filter("bodies > 1").select("mark")
    if not mixed.isEmpty():
        true = same.join(mixed, "mark", "left_semi").filter("n > 1")
        seen = seen.union(bodies.join(true, ["mark", "body"]).select(*columns))
    return seen.groupBy("doc_id", "version").agg(F.collect_set(F.struct("a", "b", "n", "kept")).alias("seen"))


def without(text: str, seen: list[dict]) -> tuple[str, int]:
    """``text`` without its repeated chunks, and how many lines went.

    A line of a later occurrence goes, unless a first occurrence that has it is of a chunk at least as frequent: so
    no first occurrence is broken but by a passage that stands in more places.
    """
    lines = text.split("\n")
    first, later = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)
    for c in seen:
        part = (first if c["kept"] else later)[c["a"]:c["b"]]
        np.maximum(part, c["n"], out=part)
    gone = later > first
    return "\n".join(x for x, dead in zip(lines, gone.tolist()) if not dead), int(gone.sum())


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with globally repeated chunks of lines removed from text; adds n_lines and lines_removed.

    A null text stays null with 0 lines; an empty text is one line.  Rows with the same id and text are one
    document: they keep the same chunks.  Within a document, a chunk that repeats loses its later
    copies.  A null id sorts first.  If every line goes, text is empty; no row is dropped.
    Columns named n_lines or lines_removed are replaced; other columns pass through.
    """
    lost = repeats(docs).select(F.col("doc_id").alias("_lost_id"), F.col("version").alias("_lost_version"), "seen")
    lost = lost.filter(F.exists("seen", lambda c: ~c["kept"]))
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "lines_removed")]
    keyed = docs.select(F.struct(*rest).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_version"), "text")
    joined = keyed.join(lost, F.col("_id").eqNullSafe(F.col("_lost_id")) & (F.col("_version") == F.col("_lost_version")), "left")
    joined = joined.select("_row", F.struct("text", "seen").alias("_cut"))

    def run(cells):
        import pyarrow as pa

        texts, counts, removed = [], [], []
        for cell in cells:
            text, seen = cell["text"], cell["seen"]
            counts.append(0 if text is None else text.count("\n") + 1)
            text, n = without(text, seen) if seen else (text, 0)
            texts.append(text)
            removed.append(n)
        return [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]

    made = add_columns(joined, "_cut", run, T.StructType.fromDDL("text string, n_lines bigint, lines_removed bigint").fields)
    order = [c if c == "text" else f"_row.`{c}`" for c in docs.columns if c in (*rest, "text")]
    return made.select(*order, "n_lines", "lines_removed")


def deduped_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks of lines removed and n_chars, where present, brought up to date."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_doc"))
    out = dedup_lines(packed)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("lines_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("_doc.n_chars"))
    return out.select(*[changed.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


#: DuckDB statement of the op9 query.
SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS MATERIALIZED (SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d)),
w AS (SELECT doc_id, i, 31 * h + lead(h) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l),
s AS (SELECT doc_id, i, seed, r >> (3 * seed)::INT AS bits FROM w, range(8) t(seed) WHERE r IS NOT NULL),
e AS (SELECT doc_id, i, bits, min(CASE WHEN (bits >> 1) & 3 <> 0 THEN i END)
        OVER (PARTITION BY doc_id, seed ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 1 AS z FROM s),
spans AS (SELECT DISTINCT doc_id, i AS a, z FROM e WHERE bits & 1 = 0 AND z IS NOT NULL
          UNION SELECT doc_id, i, i FROM l WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50),
chunk AS MATERIALIZED (SELECT doc_id, a, z, array_to_string(lines[a:z], chr(10)) AS body FROM spans JOIN d USING (doc_id)),
ranked AS (SELECT doc_id, a, z, count(*) OVER (PARTITION BY body) AS n, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) = 1 AS kept
           FROM chunk WHERE regexp_matches(body, '[^\x20\x09-\x0D]')),
cover AS (SELECT doc_id, unnest(range(a, z + 1)) AS i, n, kept FROM ranked WHERE n > 1),
gone AS (SELECT doc_id, i FROM cover GROUP BY doc_id, i
         HAVING coalesce(max(n) FILTER (WHERE NOT kept), 0) > coalesce(max(n) FILTER (WHERE kept), 0)),
done AS (SELECT doc_id, count(*) AS n_lines, count(gone.i) AS lines_removed,
                coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.i IS NULL), '') AS text FROM l LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, done.text, coalesce(n_lines, 0) AS n_lines, coalesce(lines_removed, 0) AS lines_removed FROM documents d LEFT JOIN done USING (doc_id)
"""
