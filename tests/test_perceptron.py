"""The perceptron on blocks: gradient, start and scores are those of MLlib's network, and counted rows are rows."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from rasterloom.operators import models as M
from rasterloom.operators import perceptron as P

LAYERS = [3, 6, 4, 2]


@pytest.fixture(scope="module")
def rows(spark):
    """900 rows, each three times."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 3))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(int)
    df = spark.createDataFrame([(i, int(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y))], ["id", "label", "features"])
    return df.withColumn("label", F.col("label").cast("int")).crossJoin(spark.range(3).withColumnRenamed("id", "copy")).localCheckpoint()


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    x, y, w, at = rng.normal(size=(50, 3)), rng.integers(0, 2, 50).astype(float), rng.integers(1, 4, 50).astype(float), P.start(LAYERS, 1)
    _, g = P.loss_and_gradient(at, LAYERS, x, y, w)
    for i in range(0, len(at), 7):
        e = np.eye(len(at))[i] * 1e-6
        slope = (P.loss_and_gradient(at + e, LAYERS, x, y, w)[0] - P.loss_and_gradient(at - e, LAYERS, x, y, w)[0]) / 2e-6
        assert g[i] == pytest.approx(slope, abs=1e-5)
    parts = P.add_up(at, LAYERS, [(x[:20], y[:20], w[:20]), (x[20:], y[20:], w[20:])])
    assert parts[1] == pytest.approx(g)


def test_equal_rows_are_counted_once(rows):
    scaled = rows.withColumn("scaled", F.col("features"))
    blocks = P.blocks_of(scaled)
    assert blocks.agg(F.sum("n")).first()[0] == 900
    loss, g = P.objective(blocks, LAYERS, 2700)(P.start(LAYERS, 0))
    x = np.array([r.features.toArray() for r in rows.collect()])
    y = np.array([float(r.label) for r in rows.collect()])
    want = P.loss_and_gradient(P.start(LAYERS, 0), LAYERS, x, y, np.ones(2700))
    assert loss == pytest.approx(want[0] / 2700) and g == pytest.approx(want[1] / 2700)


@pytest.mark.parametrize("work", [0, 10 ** 9])
def test_fit_is_as_good_as_mllibs_and_scores_as_its_weights_say(rows, monkeypatch, work):
    monkeypatch.setattr(P, "TASK_WORK", work)
    mine = P.Perceptron(LAYERS, 100, 1e-4, 0).fit(rows)
    theirs = M.scaled(MultilayerPerceptronClassifier(layers=LAYERS, maxIter=100, tol=1e-4, seed=0, labelCol="label")).fit(rows)
    blocks = P.blocks_of(mine.stages[0].transform(rows))
    loss = lambda m: P.objective(blocks, LAYERS, 2700)(m.stages[-1].weights.toArray())[0]
    assert loss(mine) < max(2 * loss(theirs), 0.05)
    # summed from MLlib's own probabilities, the loss is the one that was fitted: the weights are laid out as MLlib reads them
    p = F.get(vector_to_array("probability"), F.col("label"))
    for m in (mine, theirs):
        assert m.transform(rows).agg(F.avg(-F.log(p))).first()[0] == pytest.approx(loss(m), rel=1e-6)
