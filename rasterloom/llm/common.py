"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.session import materialize, ship_package

SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # white space but blank and line feed
BATCH_ROWS = 500  # texts per Arrow batch: bounds a Python worker's memory
BATCH_BYTES = 64 << 20  # bytes per Arrow batch, which long texts fill sooner


def prepare(spark: SparkSession) -> None:
    """Ship this package to the workers and bound the rows and bytes of an Arrow batch."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with underscores in front, so that it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sampled(labelled: DataFrame, key: str, per_class: int, total: int = 10_000) -> DataFrame:
    """About ``per_class`` different rows of every value of ``key``, less if all classes together passed ``total``.

    Rows are chosen by a salted hash of all their columns and equal ones count once, so repeated ids neither empty nor
    swell the sample.  It is bounded by ``total``, whatever the size of the input.
    """
    rows = labelled.distinct()
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    share = F.least(F.lit(float(per_class)), F.lit(float(total)) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    counts = counts.withColumn("_share", share)
    u = F.pmod(F.xxhash64(F.lit("sample"), *labelled.columns), F.lit(1 << 30)) / float(1 << 30)
    # A row per class; the model that is fitted holds at least as much for each, so it fits wherever the model does.
    return rows.join(F.broadcast(counts), key).filter(u * F.col("_rows") < F.col("_share")).select(*labelled.columns)


def cut_at_spaces(text: str, cut: str, glue: str) -> str:
    """``text`` with ``cut`` for its single spaces between visible characters (see ``split_at_spaces``).

    Where white space is single throughout, line feeds are cut off too; they and what follows them begin with ``glue``.
    """
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or RARE_SPACE.search(text):
        return SAFE_SPACE.sub(cut, text)
    text = text.replace(" ", cut)
    if "\n" in text and "\n\n" not in text and text[0] != "\n" and text[-1] != "\n":
        text = text.replace("\n", f"{cut}{glue}\n{cut}{glue}")
    return text


def split_at_spaces(text: str) -> list[str]:
    """``text`` cut at its single spaces between visible characters, which are left out.

    Byte-level vocabularies' pattern starts a new piece at each of them, so the parts are encoded apart.
    """
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or RARE_SPACE.search(text):
        return SAFE_SPACE.split(text)
    return text.split(" ")


def add_columns(df: DataFrame, text: str, fn, fields: list[T.StructField]) -> DataFrame:
    """``df`` with columns made by ``fn(list of texts) -> list of arrays`` from one column.

    All other columns pass through unread.  ``fields`` must not clash with ``df``.
    """
    at = df.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = fn(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *[f.name for f in fields]])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def connected(edges: DataFrame) -> DataFrame:
    """Components of ``(u, v)``: rows ``(node, root)`` of all nodes but the roots, root the smallest node reachable.

    Alternates large-star and small-star steps (grouped minimum and equi-join) on tables
    written to the shared folder, until the edges no longer change.
    """
    cur = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
