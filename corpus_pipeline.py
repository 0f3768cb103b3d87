"""The corpus pipeline: quality, line dedup, near-copy removal, source mix, tokens.

``run`` applies STAGES to documents; every stage's result is written as Parquet in the shared folder and
read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import bpe, lines, mixing, quality, shingles, simhash
from rasterloom.llm.common import prepare, table
from rasterloom.session import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts; it learns from the labels beside ``documents``."""
    prepare(spark)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of two lines or more, and repeated long lines, leave the texts; no document is dropped."""
    prepare(spark)
    return lines.deduped_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the links of op6's fingerprints, and those of five-word shingle sets at a
    Jaccard similarity of 0.8 or more, which the fingerprints' three bits do not reach."""
    prepare(spark)
    return simhash.one_of_each(docs, simhash.with_links(simhash.components(docs), shingles.components(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents up to its target, repeated where the target exceeds the source."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to."""
    prepare(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near copies", drop_near_copies),
    ("mix", mix_sources),
    ("byte bpe", tokens),
]

#: SQL can't express the classifier, the fingerprints or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
