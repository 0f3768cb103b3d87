"""Registry of named queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rasterloom.session import prepare
from rasterloom.sources.tables import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str | None = None, sql: str | None = None):
    """Register ``fn(spark, root)``; ``views`` and ``sql`` give the oracle where one exists."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @wraps(fn)
        def run(spark: SparkSession, root: str) -> DataFrame:
            prepare(spark)
            return fn(spark, root)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql
        return fn

    return add
