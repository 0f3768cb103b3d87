"""The registered queries of the training-data operators and the SQL that states them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import ann, bpe, centroids, decontam, langid, lattice, license, lines, mixing, negatives, quality, simhash, tokens
from rasterloom.llm.common import fold, prepare, table
from rasterloom.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_language")
def language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


@query("op2_quality")
def quality_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    held_out = (fold(F.col("doc_id"), quality.FOLDS) == quality.HELD_OUT).alias("held_out")
    return quality.score(docs.select("doc_id", "text", "n_chars"), model).select("doc_id", held_out, "score", "predicted")


@query("op3_cross_polytope")
def cross_polytope(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


@query("op4_byte_bpe")
def byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_lattice")
def lattice_links(spark, sf_dir):
    return lattice.near_copies(table(spark, sf_dir, "embeddings"))


@query("op6_golay_simhash")
def golay_simhash(spark, sf_dir):
    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query("op7_license_templates")
def license_templates(spark, sf_dir):
    return license.summary(license.scan(table(spark, sf_dir, "documents")))


@query("op8_token_files")
def token_files(spark, sf_dir):
    out = f"{scratch_dir(spark)}/token-files-{uuid4().hex}"
    tokens.write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokens.read_checksums(spark, out)


@query("op9_line_dedup", lines.SQL)
def line_dedup(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_source_mix", mixing.SQL)
def source_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_decontamination", decontam.SQL)
def decontamination(spark, sf_dir):
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_centroids", centroids.SQL)
def centroid_clusters(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


@query("op13_hard_negatives", negatives.SQL)
def hard_negatives(spark, sf_dir):
    return negatives.mine(table(spark, sf_dir, "embeddings"), negatives.relabelled(F.col("vec_id"), F.col("label")))
