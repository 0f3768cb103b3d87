"""MLlib's perceptron, fitted on blocks of distinct rows.

The loss is a sum over rows, so equal rows of one label are one row with a count.  Distinct rows lie in blocks of bytes; a step of
L-BFGS is one pass in which every task multiplies its blocks and returns one gradient.  A small fit (``TASK_WORK``) takes less than the
start of such a pass and is one task, so that several run side by side.  Layers, loss, start, memory, and the rule that ends
the fit are MLlib's (sigmoid layers, softmax with cross entropy, 10 corrections, a loss within ``tol`` of the first loss's scale over 20 steps).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.session import materialize, prepare

BLOCK_CELLS = 1 << 16  # values of a block, one row at least
STEP_CELLS = 1 << 13  # values of a layer that are multiplied at once: they stay in a core's cache
TASK_WORK, TASK_CELLS = 2 * 10 ** 8, 1 << 22  # distinct rows times weights, and values, of a fit that one task does whole
CORRECTIONS, HISTORY = 10, 20


def blocks_of(rows: DataFrame) -> DataFrame:
    """(n, x, y, w): blocks of distinct rows as bytes, with their labels and counts."""
    spark = rows.sparkSession
    prepare(spark)
    cores = spark.sparkContext.defaultParallelism
    x = rows.select(vector_to_array("scaled").alias("x"), F.col("label").cast("int").alias("y"))
    once = x.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y, w = b.column(1).to_numpy(zero_copy_only=False).astype(float), b.column(2).to_numpy(zero_copy_only=False).astype(float)
            step = max(1, BLOCK_CELLS // max(v.shape[1], 64))
            cut = [slice(a, a + step) for a in range(0, len(v), step)]
            yield pa.record_batch([pa.array([len(y[c]) for c in cut], pa.int32()), *[pa.array([u[c].tobytes() for c in cut], pa.binary()) for u in (v, y, w)]],
                                  names=["n", "x", "y", "w"])

    return materialize(once.repartition(cores, "x", "y").mapInArrow(pack, "n int, x binary, y binary, w binary"), "blocks")


def shapes(layers: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, inputs, outputs) of every layer in the flat weights: its matrix by columns, then its biases."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((at, a, b))
        at += a * b + b
    return out


def start(layers: Sequence[int], seed: int) -> np.ndarray:
    """Uniform within 2.4 over the root of a layer's inputs, as MLlib draws them."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-2.4, 2.4, a * b + b) / np.sqrt(a) for _, a, b in shapes(layers)])


def loss_and_gradient(weights, layers, x, y, w):
    """Summed cross entropy of a block and its gradient."""
    parts = [(weights[s:s + a * b].reshape(a, b), weights[s + a * b:s + a * b + b]) for s, a, b in shapes(layers)]
    outs = [x]
    for i, (m, bias) in enumerate(parts):
        z = outs[-1] @ m
        z += bias
        if i < len(parts) - 1:
            np.negative(z, out=z)
            np.clip(z, None, 700, out=z)
            np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
        outs.append(z)
    z = outs.pop()
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    total = e.sum(axis=1)
    k = y.astype(np.int64)
    at = np.arange(len(k))
    loss = float(np.dot(w, np.log(total) - z[at, k]))
    d = e / total[:, None]
    d[at, k] -= 1
    d *= w[:, None]
    gradient = np.empty_like(weights)
    for (s, a, b), (m, _), h in zip(shapes(layers)[::-1], parts[::-1], outs[::-1]):
        gradient[s:s + a * b] = (h.T @ d).ravel()
        gradient[s + a * b:s + a * b + b] = d.sum(axis=0)
        if s:
            d = d @ m.T
            d *= h
            d *= 1 - h
    return loss, gradient


def add_up(weights, layers, blocks):
    """Loss and gradient of several blocks, a few rows at a time."""
    step = max(32, STEP_CELLS // max(layers[1:]))
    loss, gradient = 0.0, np.zeros_like(weights)
    for x, y, w in blocks:
        for a in range(0, len(y), step):
            one, g = loss_and_gradient(weights, layers, x[a:a + step], y[a:a + step], w[a:a + step])
            loss += one
            gradient += g
    return loss, gradient


def unpack(batches):
    for b in batches:
        for n, x, y, w in zip(b.column(0).to_pylist(), *[b.column(i) for i in (1, 2, 3)]):
            x, y, w = (np.frombuffer(v.as_buffer(), np.float64) for v in (x, y, w))
            yield x.reshape(n, -1), y, w


def fit_in_a_task(blocks: DataFrame, layers: Sequence[int], rows: int, max_iter: int, tol: float, seed: int) -> np.ndarray:
    layers = list(layers)

    def fit(batches):
        import pyarrow as pa

        held = [tuple(v.copy() for v in b) for b in unpack(batches)]

        def at(weights):
            loss, gradient = add_up(weights, layers, held)
            return loss / rows, gradient / rows

        yield pa.record_batch([pa.array([minimize(at, start(layers, seed), max_iter, tol).tobytes()], pa.binary())], names=["weights"])

    return np.frombuffer(blocks.coalesce(1).mapInArrow(fit, "weights binary").first()["weights"])


def objective(blocks: DataFrame, layers: Sequence[int], rows: int):
    """Mean loss and gradient over all rows, one pass a call; a task sends one sum."""
    layers = list(layers)

    def at(weights):
        def add(batches):
            import pyarrow as pa

            loss, gradient = add_up(weights, layers, unpack(batches))
            yield pa.record_batch([pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], names=["loss", "gradient"])

        got = blocks.mapInArrow(add, "loss double, gradient binary").collect()
        return sum(r["loss"] for r in got) / rows, sum(np.frombuffer(r["gradient"]) for r in got) / rows

    return at


def search(f, x, value, g, d, first):
    """Step along ``d`` that meets the strong Wolfe conditions: bracket, then narrow by cubic guesses."""
    slope, c1, c2 = float(g @ d), 1e-4, 0.9
    low, high, step = (0.0, value, slope), None, first
    best = None
    for _ in range(20):
        v, grad = f(x + step * d)
        s = float(grad @ d)
        if np.isfinite(v) and (best is None or v < best[1]):
            best = (step, v, grad)
        if not np.isfinite(v) or v > value + c1 * step * slope or v >= low[1] and low[0] > 0:
            high = (step, v, s)
        elif abs(s) <= -c2 * slope:
            return step, v, grad
        elif high is None and s < 0:
            low, step = (step, v, s), step * 2
            continue
        else:
            if s * ((high[0] if high else 0.0) - low[0]) >= 0 or high is None:
                high = low
            low = (step, v, s)
        a, b = low, high
        gap = b[0] - a[0]
        step = a[0] + gap / 2
        if np.isfinite(b[1]):
            t = a[2] + b[2] - 3 * (b[1] - a[1]) / gap
            root = t * t - a[2] * b[2]
            if root > 0:
                root = np.sqrt(root) * np.sign(gap)
                guess = b[0] - gap * (b[2] + root - t) / (b[2] - a[2] + 2 * root)
                if np.isfinite(guess) and min(a[0], b[0]) + 0.1 * abs(gap) <= guess <= max(a[0], b[0]) - 0.1 * abs(gap):
                    step = guess
        if abs(gap) < 1e-10:
            break
    return best if best is not None and best[1] < value else None


def minimize(f, x: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """L-BFGS until the loss moves by no more than ``tol`` of the first over ``HISTORY`` steps, or the gradient is as small."""
    value, g = f(x)
    began, past, pairs = abs(value), [value], []
    for _ in range(max_iter):
        if np.linalg.norm(g) <= max(tol * abs(value), 1e-8):
            break
        d, kept = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            d = d - a * y
            kept.append(a)
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(kept)):
            d = d + s * (a - (y @ d) / (s @ y))
        got = search(f, x, value, g, d, 1.0 if pairs else 1.0 / max(np.linalg.norm(g), 1e-12))
        if got is None:
            break
        step, v, grad = got
        s, y = step * d, grad - g
        x, value, g = x + s, v, grad
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-CORRECTIONS:]
        past = [*past, value][-HISTORY:]
        if len(past) >= 2 and abs(value - max(past)) <= tol * began:
            break
    return x


class Perceptron:
    """The perceptron behind a scaler that is fitted with it, as MLlib's pipeline model."""

    def __init__(self, layers: Sequence[int], max_iter: int, tol: float, seed: int):
        self.layers, self.max_iter, self.tol, self.seed = list(layers), max_iter, tol, seed

    def fit(self, rows: DataFrame) -> PipelineModel:
        spark = rows.sparkSession
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(rows)
        blocks = blocks_of(scaler.transform(rows))
        distinct = blocks.agg(F.sum("n")).first()[0]
        n = rows.count()
        size = sum(a * b + b for _, a, b in shapes(self.layers))
        if distinct * size <= TASK_WORK and distinct * self.layers[0] <= TASK_CELLS:
            weights = fit_in_a_task(blocks, self.layers, n, self.max_iter, self.tol, self.seed)
        else:
            weights = minimize(objective(blocks, self.layers, n), start(self.layers, self.seed), self.max_iter, self.tol)
        # the flat weights hold a layer's matrix by columns of (outputs, inputs), which are rows of (inputs, outputs)
        made = spark.sparkContext._jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel
        uid = f"blocks_{abs(hash((n, *self.layers)))}"
        model = MultilayerPerceptronClassificationModel(made(uid, _py2java(spark.sparkContext, Vectors.dense(weights))))
        model._set(layers=self.layers, seed=self.seed, maxIter=self.max_iter, tol=self.tol)
        return PipelineModel([scaler, model.setFeaturesCol("scaled")])
