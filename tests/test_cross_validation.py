"""Every fit of a grouped evaluation reads all rows of the other folds."""

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import models as M

FOLDS, PER_FOLD = 3, 50_000


class Constant(M.FittedPair):
    def score(self, rows):
        return rows.withColumn("p", F.lit(0.7))


class Counting:
    """Stands in for an architecture and notes what a fit reads."""

    def __init__(self, seen):
        self.seen = seen

    def fit(self, rows):
        self.seen.append((rows.count(), {r["fold"] for r in rows.select("fold").distinct().collect()}, rows.rdd.getNumPartitions()))
        return Constant({})


@pytest.fixture
def noted(monkeypatch):
    """What the fits of a query read, whatever architecture it names."""
    seen = []
    monkeypatch.setattr(M, "estimators", lambda *a, **k: dict.fromkeys(("logistic", "mlp", "hybrid_mlp"), Counting(seen)))
    monkeypatch.setattr(M.Pair, "fit", lambda self, rows: Counting(seen).fit(rows))
    return seen


def test_fits_read_all_rows_of_the_other_folds(spark):
    rows = spark.range(FOLDS * PER_FOLD).select("id", (F.col("id") % 300).alias("g"), (F.col("id") % 2).cast("int").alias("label"), F.lit(1.0).alias("features"))
    folds = spark.range(300).select(F.col("id").alias("g"), (F.col("id") % FOLDS).cast("int").alias("fold"))
    seen = []
    scored = M.cross_validate(rows, folds, "g", ["id"], lambda: Counting(seen))
    assert sorted(n for n, _, _ in seen) == [2 * PER_FOLD] * FOLDS and all(len(f) == FOLDS - 1 for _, f, _ in seen)
    assert all(p >= spark.sparkContext.defaultParallelism for _, _, p in seen)
    assert scored.count() == FOLDS * PER_FOLD


@pytest.mark.parametrize("name, fits, folds", [("l10_grouped_cross_validation", 5, 5), ("l12_leave_one_group_out", None, None), ("l13_leak_check", 8, 4)])
def test_model_queries_read_all_rows(spark, noted, name, fits, folds):
    import __spark_entry__ as entry
    from rasterloom.sources import tables as T

    root = "/root/testdata/sf0.1"  # 600 000 rows
    entry.queries()[name](spark, root).collect()
    k = folds or len(noted)
    assert len(noted) == (fits or k)
    n = T.table(spark, root, "lineitem").count()
    assert sum(c for c, _, _ in noted) == n * (k - 1) * len(noted) // k
