"""Trees grown on counted cells against MLlib's, and every row in a cell."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from rasterloom.operators import cells as C
from rasterloom.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    """4000 rows on few values, so that MLlib's bins are one per value as well."""
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, 20, 4000) / 2, rng.integers(0, 9, 4000) ** 2, rng.integers(0, 4, 4000)], 1).astype(float)
    y = ((x[:, 0] * 3 + x[:, 1] / 4 + rng.normal(0, 3, 4000)) > 22).astype(int)
    df = spark.createDataFrame([(i, int(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y))], ["id", "label", "features"])
    return df.withColumn("label", F.col("label").cast("int")).localCheckpoint()


def probabilities(df):
    return np.array([r.p for r in df.orderBy("id").select("p").collect()])


def test_cells_count_every_row(spark, rows):
    cuts, codes, counts = C.gather(rows, 3)
    assert [len(c) for c in cuts] == [19, 8, 3] and counts.sum() == 4000
    x = np.array([r.features.toArray() for r in rows.collect()])
    want = {tuple(np.searchsorted(c, v) for c, v in zip(cuts, r)) for r in x}
    assert {tuple(c) for c in codes.tolist()} == want
    assert counts[:, 1].sum() == rows.agg(F.sum("label")).first()[0]


def test_many_values_are_cut_at_even_ranks_of_all_rows(spark):
    df = spark.range(50_000).select(array_to_vector(F.array((F.col("id") * F.col("id")).cast("double"), F.lit(1.0))).alias("features"))
    cut, none = C.thresholds(df)
    assert len(none) == 0
    assert np.abs(np.sqrt(cut) - 50_000 / 32 * np.arange(1, 32)).max() < 1  # a sample of 10 000 rows would be off by hundreds


def test_boosting_equals_mllib(rows):
    mine, theirs = (M.Boosting(None, 12, 4, 0).fit(rows), M.GBTClassifier(maxIter=12, maxDepth=4, seed=0, labelCol="label").fit(rows))
    want = probabilities(theirs.transform(rows).withColumn("p", vector_to_array("probability")[1]))
    assert probabilities(mine.score(rows)) == pytest.approx(want, abs=1e-9)
    assert probabilities(mine.transform(rows).withColumn("p", vector_to_array("probability")[1])) == pytest.approx(want, abs=1e-9)


def test_one_tree_on_all_rows_equals_mllib(rows):
    _, codes, counts = C.gather(rows, 3)
    cuts = C.thresholds(rows)
    t, _ = C.grow(codes, [len(c) + 1 for c in cuts], counts.sum(axis=1), counts[:, 1], 6, True)
    theirs = M.DecisionTreeClassifier(maxDepth=6, labelCol="label").fit(rows)
    assert len(C.pruned(t)["W"]) == theirs.numNodes


@pytest.mark.parametrize("name", ["forest", "extra_trees"])
def test_forest_scores_as_its_mllib_model_and_close_to_mllibs_own(rows, name):
    e = M.estimators(3)[name]
    e.trees = 40
    mine = e.fit(rows)
    assert mine.stages[-1].getNumTrees == 40
    p = probabilities(M.score(mine, rows))
    assert p == pytest.approx(probabilities(mine.transform(rows).withColumn("p", vector_to_array("probability")[1])), abs=1e-9)
    e.plain.getStages()[-1].setNumTrees(40)
    q = probabilities(M.score(e.plain.fit(rows), rows))
    assert ((p > 0.5) == (q > 0.5)).mean() > 0.97 and np.abs(p - q).mean() < 0.03


def test_bootstrap_draws_rows_not_cells(spark):
    """600 equal rows of either label: a tree's share of label 1 varies as for 1200 draws, not as for two."""
    df = spark.range(1200).select(F.col("id"), (F.col("id") % 2).cast("int").alias("label"), array_to_vector(F.array(F.lit(1.0), F.lit(2.0))).alias("features"))
    e = M.estimators(2)["forest"]
    e.trees = 64
    stats = e.fit(df).nodes.select("nodeData.impurityStats").toPandas()["impurityStats"]
    share = np.array([s[1] / sum(s) for s in stats])
    assert 0.004 < share.std() < 0.04 and len(share) == 64


def test_too_many_cells_are_left_to_mllib(rows, monkeypatch):
    monkeypatch.setattr(C, "MAX_CELL_BYTES", 40)
    assert C.gather(rows, 3) is None
    e = M.estimators(3)["forest"]
    e.plain.getStages()[-1].setNumTrees(2)
    assert M.score(e.fit(rows), rows).count() == 4000
