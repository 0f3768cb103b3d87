"""Tree ensembles on counted cells, as MLlib models.

MLlib's trees see a feature only by its bin (32 at most), so rows with equal bins and label are the same row to them.  Every
row is counted into its cell once; trees are then grown on the cells, whose number depends on the bins and not on the rows.
A bootstrap draws every row of a cell Poisson(1) times, which is Poisson(n) times for its n rows together.  Split rules,
impurities, pruning and boosting are MLlib's; only its bins are not: they come from the ranks of all values, not from 10 000 rows.
"""

from __future__ import annotations

import json
import time
import uuid

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.ordered import running_total
from rasterloom.session import materialize, prepare, scratch_dir

MAX_BINS = 32
MAX_CELL_BYTES = 1 << 25  # of the cells' codes, which a fit's tasks hold whole; tables with more are left to MLlib
MERGE_AT = 1 << 18  # counted cells that a worker holds before it merges equal ones
SEEN_CELLS = 1 << 20  # scored cells that a worker remembers
LEAST_GAIN = 1e-14  # below it a gain is rounding

NODES = """treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double,
    leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"""


def thresholds(rows: DataFrame, bins: int = MAX_BINS) -> list[np.ndarray]:
    """Ascending split candidates of every feature, halfway between the neighbouring values of two bins.

    A feature with ``bins`` values or fewer has a bin for each.  Otherwise a value goes to the bin in which the middle of its
    ranks lies, so a border is the one nearest to an even share of all rows.
    """
    x = rows.select(F.posexplode(vector_to_array("features")).alias("f", "v"))
    values = materialize(x.groupBy("f", "v").agg(F.count(F.lit(1)).alias("n")), "values")
    span = {r["f"]: r for r in values.groupBy("f").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("d"), F.sum("n").alias("n")).collect()}
    of = lambda g: F.get(F.array(*[F.lit(float(g(span[i]))) for i in range(len(span))]), F.col("f"))
    bucket = F.floor((F.col("v") - of(lambda r: r["lo"])) / of(lambda r: (r["hi"] - r["lo"]) or 1.0) * 255)
    ranked = running_total(values, ["f"], bucket, [F.asc("v")], {"end": "n"})
    share = F.floor((F.col("end") - F.col("n") / 2) / of(lambda r: r["n"] / bins))
    binned = ranked.groupBy("f", F.when(of(lambda r: r["d"]) <= bins, F.col("v")).otherwise(share).alias("b")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    per = [[] for _ in span]
    for r in sorted(binned.collect(), key=lambda r: r["lo"]):
        per[r["f"]].append((r["lo"], r["hi"]))
    cut = lambda a, b: a + (b - a) / 2 if a + (b - a) / 2 < b else a
    return [np.array([cut(a[1], b[0]) for a, b in zip(p, p[1:])]) for p in per]


def count_cells(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """(cell, n): a cell is one byte per feature, its bin, and one for the label."""
    n = len(cuts)
    radix = [len(c) + 1 for c in cuts] + [2]
    narrow = float(np.prod([float(r) for r in radix])) < 2 ** 62

    def merge(parts):
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)

    def out(keys, counts):
        import pyarrow as pa

        code = np.empty((len(keys), n + 1), np.uint8)
        for i in range(n, -1, -1):
            keys, code[:, i] = np.divmod(keys, radix[i])
        return pa.record_batch([pa.array([r.tobytes() for r in code], pa.binary()), pa.array(counts)], names=["cell", "n"])

    def count(batches):
        import pyarrow as pa

        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            code = [np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)] + [b.column(1).to_numpy(zero_copy_only=False)]
            if not narrow:
                code = np.stack(code, 1).astype(np.uint8)
                yield pa.record_batch([pa.array([r.tobytes() for r in code], pa.binary()), pa.array(np.ones(len(code), np.int64))], names=["cell", "n"])
                continue
            key = np.zeros(len(x), np.int64)
            for c, r in zip(code, radix):
                key = key * r + c
            held.append(np.unique(key, return_counts=True))
            size += len(held[-1][0])
            if size > MERGE_AT:
                held = [merge(held)]
                size = len(held[0][0])
                if size > MERGE_AT // 2:
                    yield out(*held[0])
                    held, size = [], 0
        if held:
            yield out(*merge(held))

    prepare(rows.sparkSession)
    x = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"))
    return x.mapInArrow(count, "cell binary, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def gather(rows: DataFrame, n: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray] | None:
    """Split candidates, codes of the distinct cells and their rows of label 0 and 1; none if the cells are too many."""
    if rows.filter("label NOT IN (0, 1)").limit(1).count():
        return None
    cuts = thresholds(rows)
    if len(cuts) != n:
        return None  # no rows
    most = MAX_CELL_BYTES // (n + 1)
    got = count_cells(rows, cuts).limit(most + 1).toPandas()
    if len(got) > most:
        return None
    code = np.frombuffer(b"".join(bytes(c) for c in got["cell"]), np.uint8).reshape(-1, n + 1)
    order = np.lexsort(code.T[::-1])
    code, rows_of = code[order], got["n"].to_numpy()[order]
    new = np.r_[True, (code[1:, :n] != code[:-1, :n]).any(axis=1)]
    at = np.cumsum(new) - 1
    counts = np.zeros((at[-1] + 1, 2))
    counts[at, code[:, n]] = rows_of
    return cuts, code[new, :n], counts


def grow(codes, bins, w, s, depth, gini, q=None, some=None, rng=None):
    """One tree, level by level: arrays of its nodes, children after their parents, and the leaf of every cell.

    ``w`` and ``s`` are a cell's weight and sum of targets, ``q`` that of their squares.  ``some`` features, drawn for each node, may split it.
    """
    pure = (lambda a, b: (b * b + (a - b) * (a - b)) / a) if gini else (lambda a, b: b * b / a)  # the part of the impurity that splits move
    q = s if q is None else q
    n = codes.shape[1]
    at, here = np.zeros(len(w), np.int64), np.arange(len(w))
    leaf = np.zeros(len(w), np.int64)
    levels, first = [], 0
    for level in range(depth + 1):
        a = int(at.max()) + 1
        W, S, Q = (np.bincount(at, v, a) for v in (w, s, q))
        parent = pure(W, S)
        spread = (W - parent if gini else Q - parent) / W
        best, f, k = np.full(a, -np.inf), np.full(a, -1), np.full(a, -1)
        if level < depth:
            if some is not None and some < n:
                use = np.argsort(rng.random((a, n)), axis=1).argsort(axis=1) < some
            for i in range(n):
                if bins[i] < 2:
                    continue
                h = at * bins[i] + codes[:, i]
                lw, ls = (np.bincount(h, v, a * bins[i]).reshape(a, -1).cumsum(axis=1)[:, :-1] for v in (w, s))
                rw, rs = W[:, None] - lw, S[:, None] - ls
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = pure(lw, ls) + pure(rw, rs)
                gain[(lw <= 0) | (rw <= 0)] = -np.inf
                if some is not None and some < n:
                    gain[~use[:, i]] = -np.inf
                c = gain.argmax(axis=1)
                v = gain[np.arange(a), c]
                more = v > best
                best[more], f[more], k[more] = v[more], i, c[more]
        gain = (best - parent) / W
        split = (gain > LEAST_GAIN) & (spread > LEAST_GAIN)
        ids = first + a + 2 * (np.cumsum(split) - 1)
        levels.append((W, S, Q, spread, np.where(split, gain, -1.0), np.where(split, ids, -1), np.where(split, f, -1), np.where(split, k, -1)))
        leaf[here] = first + at
        on = split[at]
        if not on.any():
            break
        codes, w, s, q, at, here = codes[on], w[on], s[on], q[on], at[on], here[on]
        at = 2 * (np.cumsum(split) - 1)[at] + (codes[np.arange(len(at)), f[at]] > k[at])
        first += a
    W, S, Q, spread, gain, child, f, k = (np.concatenate(v) for v in zip(*levels))
    said = (S > W - S).astype(float) if gini else S / W
    return {"W": W, "S": S, "Q": Q, "spread": spread, "gain": gain, "child": child, "f": f, "k": k, "said": said}, leaf


def pruned(t):
    """Sister leaves that say the same become their parent; nodes are numbered anew."""
    child, keep = t["child"].copy(), np.ones(len(t["child"]), bool)
    for i in np.flatnonzero(child >= 0)[::-1]:
        c = child[i]
        if child[c] < 0 and child[c + 1] < 0 and t["said"][c] == t["said"][c + 1]:
            child[i], keep[c], keep[c + 1] = -1, False, False
    number = np.cumsum(keep) - 1
    out = {name: v[keep] for name, v in t.items()}
    child = child[keep]
    inner = child >= 0
    out["child"] = np.where(inner, number[np.maximum(child, 0)], -1)
    out["gain"] = np.where(inner, out["gain"], -1.0)
    return out


def node_rows(tree, t, cuts, gini):
    """A batch of MLlib's table of nodes."""
    import pyarrow as pa

    n, inner = len(t["W"]), t["child"] >= 0
    lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))
    start = np.r_[0, np.cumsum([len(c) for c in cuts])]
    cut = np.concatenate([*cuts, [0.0]])[(start[t["f"]] + t["k"])[inner]]
    stats = np.stack([t["W"] - t["S"], t["S"]] if gini else [t["W"], t["S"], t["Q"]], 1)
    ints = lambda v: pa.array(v.astype(np.int32))
    split = pa.StructArray.from_arrays([ints(np.where(inner, t["f"], -1)), lists(cut, inner), ints(np.full(n, -1))],
                                       names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    node = pa.StructArray.from_arrays(
        [ints(np.arange(n)), pa.array(t["said"]), pa.array(np.maximum(t["spread"], 0.0)), lists(stats.ravel(), np.full(n, stats.shape[1])),
         pa.array(np.rint(t["W"]).astype(np.int64)), pa.array(t["gain"]), ints(t["child"]), ints(np.where(inner, t["child"] + 1, -1)), split],
        names=["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.record_batch([ints(np.full(n, tree)), node], names=["treeID", "nodeData"])


def load(spark, nodes: DataFrame, reader, cuts: list[np.ndarray], weights: list[float], depth: int, seed: int, gini: bool) -> "Ensemble":
    """The model whose trees are ``nodes``, through MLlib's own format on disk."""
    path = f"{scratch_dir(spark)}/trees-{uuid.uuid4().hex}"
    nodes.write.parquet(f"{path}/data")
    kind = "classification.DecisionTreeClassificationModel" if gini else "regression.DecisionTreeRegressionModel"

    def meta(name, uid, params, **more):
        return json.dumps({"class": f"org.apache.spark.ml.{name}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
                           "paramMap": {"impurity": "gini" if gini else "variance", "maxDepth": depth, "seed": seed, **params}, "defaultParamMap": {}, **more})

    own = meta(f"classification.{reader.__name__}", f"cells_{uuid.uuid4().hex[:12]}", {"labelCol": "label", "featuresCol": "features", "numTrees" if gini else "maxIter": len(weights)},
               numFeatures=len(cuts), numTrees=len(weights), **({"numClasses": 2} if gini else {}))
    spark.createDataFrame([(own,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    trees = [(i, meta(kind, f"tree_{uuid.uuid4().hex[:12]}", {}), float(w)) for i, w in enumerate(weights)]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    return Ensemble(PipelineModel([reader.load(path)]), spark.read.schema(NODES).parquet(f"{path}/data"), cuts, weights, gini)


def walk(trees, codes):
    """Codes to probability of label 1, as MLlib's model has it."""
    root, weights, child, f, k, value, gini = trees
    total = np.zeros(len(codes))
    for at, w in zip(root, weights):
        node, on = np.full(len(codes), at, np.int32), np.arange(len(codes))
        while True:
            on = on[child[node[on]] >= 0]
            if not len(on):
                break
            here = node[on]
            node[on] = child[here] + (codes[on, f[here]] > k[here])
        total += w * value[node]
    return total / len(weights) if gini else 1 / (1 + np.exp(-2 * total))


class Ensemble:
    """A fitted ensemble: MLlib's model (``stages``, ``transform``) and a way to score rows that walks the trees once per cell, not per row."""

    def __init__(self, model: PipelineModel, nodes: DataFrame, cuts: list[np.ndarray], weights: list[float], gini: bool):
        self.model, self.stages, self.transform = model, model.stages, model.transform
        self.nodes, self.cuts, self.weights, self.gini = nodes, cuts, weights, gini

    def trees(self):
        """Arrays of all nodes and where each tree begins."""
        d = F.col("nodeData")
        t = self.nodes.select("treeID", d.id.alias("id"), d.prediction.alias("said"), d.impurityStats[0].alias("a"), d.impurityStats[1].alias("b"),
                              d.leftChild.alias("child"), d.split.featureIndex.alias("f"), F.get(d.split.leftCategoriesOrThreshold, 0).alias("cut")).toPandas()
        t = t.sort_values(["treeID", "id"])
        root = np.searchsorted(t["treeID"].to_numpy(), np.arange(len(self.weights)))
        child = t["child"].to_numpy()
        child = np.where(child >= 0, child + root[t["treeID"].to_numpy()], -1).astype(np.int32)
        f, cut = t["f"].to_numpy(), t["cut"].fillna(0.0).to_numpy()
        k = np.zeros(len(t), np.int32)
        for i, c in enumerate(self.cuts):
            k[f == i] = np.searchsorted(c, cut[f == i])
        value = (t["b"] / (t["a"] + t["b"])).to_numpy() if self.gini else t["said"].to_numpy()
        return root, np.array(self.weights), child, f, k, value, self.gini

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``p``; a worker walks the trees for a cell when it first meets it."""
        radix, n = [len(c) + 1 for c in self.cuts], len(self.cuts)
        if float(np.prod([float(r) for r in radix])) >= 2 ** 62:
            return self.model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        spark = rows.sparkSession
        prepare(spark)
        shared = spark.sparkContext.broadcast((self.cuts, self.trees()))
        seen = {}

        def look_up(x):
            import pyarrow as pa

            cuts, trees = shared.value
            v = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            codes = np.stack([np.searchsorted(c, v[:, i]) for i, c in enumerate(cuts)], 1)
            key = np.zeros(len(v), np.int64)
            for i, r in enumerate(radix):
                key = key * r + codes[:, i]
            known, p = seen.get("cells", (np.zeros(0, np.int64), np.zeros(0)))
            at = np.searchsorted(known, key)
            new = np.ones(len(key), bool)
            if len(known):
                new = known[np.minimum(at, len(known) - 1)] != key
            if new.any():
                if len(known) > SEEN_CELLS:
                    known, p, new = known[:0], p[:0], np.ones(len(key), bool)
                more, first = np.unique(key[new], return_index=True)
                to = np.searchsorted(known, more)
                known, p = np.insert(known, to, more), np.insert(p, to, walk(trees, codes[new][first]))
                seen["cells"] = known, p
                at = np.searchsorted(known, key)
            return pa.array(p[at])

        return rows.withColumn("p", F.arrow_udf(look_up, "double")(vector_to_array("features")))


class Forest:
    """Random forest (or, without bootstrap, trees that differ by the features drawn for their nodes); ``plain`` is MLlib's own."""

    def __init__(self, plain, trees: int, depth: int, seed: int, bootstrap: bool = True):
        self.plain, self.trees, self.depth, self.seed, self.bootstrap = plain, trees, depth, seed, bootstrap

    def fit(self, rows: DataFrame):
        spark, n = rows.sparkSession, len(rows.select(vector_to_array("features")).head()[0])
        held = gather(rows, n)
        if held is None:
            return self.plain.fit(rows)
        cuts, _, _ = held
        shared = spark.sparkContext.broadcast(held)
        depth, seed, bootstrap, some = self.depth, self.seed, self.bootstrap, int(np.ceil(np.sqrt(n)))

        def plant(batches):
            _, codes, counts = shared.value
            bins = [len(c) + 1 for c in cuts]
            for b in batches:
                for tree in b.column(0).to_pylist():
                    rng = np.random.default_rng([seed, tree])
                    drawn = rng.poisson(counts).astype(float) if bootstrap else counts
                    on = drawn.sum(axis=1) > 0
                    if not on.any():
                        drawn, on = counts, np.ones(len(counts), bool)
                    t, _ = grow(codes[on], bins, drawn[on].sum(axis=1), drawn[on, 1], depth, True, some=some, rng=rng)
                    yield node_rows(tree, pruned(t), cuts, True)

        slots = min(self.trees, 2 * spark.sparkContext.defaultParallelism)
        nodes = spark.range(0, self.trees, 1, slots).mapInArrow(plant, NODES)
        return load(spark, nodes, RandomForestClassificationModel, cuts, [1.0] * self.trees, depth, seed, True)


class Boosting:
    """Gradient-boosted trees with MLlib's logistic loss and step; one task follows the cells through all rounds."""

    def __init__(self, plain, rounds: int, depth: int, seed: int, step: float = 0.1):
        self.plain, self.rounds, self.depth, self.seed, self.step = plain, rounds, depth, seed, step

    def fit(self, rows: DataFrame):
        spark, n = rows.sparkSession, len(rows.select(vector_to_array("features")).head()[0])
        held = gather(rows, n)
        if held is None:
            return self.plain.fit(rows)
        cuts, _, _ = held
        shared = spark.sparkContext.broadcast(held)
        depth, rounds = self.depth, self.rounds
        weights = [1.0] + [self.step] * (rounds - 1)

        def boost(batches):
            _, codes, counts = shared.value
            bins, sign, total = [len(c) + 1 for c in cuts], np.array([-1.0, 1.0]), None
            w = counts.sum(axis=1)
            for _ in batches:
                for tree in range(rounds):
                    target = sign[None, :] if total is None else 4 * sign / (1 + np.exp(2 * sign * total[:, None]))
                    t, leaf = grow(codes, bins, w, (counts * target).sum(axis=1), depth, False, q=(counts * target * target).sum(axis=1))
                    total = (0.0 if total is None else total) + weights[tree] * t["said"][leaf]
                    yield node_rows(tree, pruned(t), cuts, False)

        nodes = spark.range(0, 1, 1, 1).mapInArrow(boost, NODES)
        return load(spark, nodes, GBTClassificationModel, cuts, weights, depth, self.seed, False)
