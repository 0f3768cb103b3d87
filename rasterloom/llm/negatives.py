"""Hard negatives of anchors, with scores bounded along a spanning tree of the anchors.

Anchors are cut into blocks of similar direction, and each block's minimum spanning tree says in which order they are
scored.  A chunk of candidates meets every block: the root's scores are taken exactly, and a child's score with a candidate lies within
edge length times candidate norm of its parent's, by Cauchy and Schwarz.  Only candidates whose interval reaches into what the child asks
for, its best positives or its windows of negatives, are scored again, in integers; the others hand their interval down.
A first pass finds the positives, whose scores make the windows of the second.  What travels is a
chunk's candidates once and the anchors once per chunk; a task gives each anchor's best rows only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.centroids import is_finite, matrix, whole_numbers
from rasterloom.session import materialize

SCALE = 256
REACH = 1 << 22  # largest integer component; what lies beyond counts as this, so that 100 times a score fits a long
POSITIVES = 5
NEGATIVES = 10
WINDOW = (30, 90)  # percent of the positive's score between which a negative's lies
EVERY = 100
BLOCK = 256  # anchors of a tree, on average
CHUNK = 8192  # candidates that a task holds, on average
SEED = 23
EXACT = 1 << 53


def relabelled(vec_id: Column, label: Column, every: int = 7, classes: int = 10) -> Column:
    """The label, moved on by one where ``every`` divides the id."""
    return F.when(vec_id % every == 0, (label + 1) % classes).otherwise(label)


def prepared(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, dim, q, norm) of the rows that take part, one per id: the smallest label and vector where an id repeats."""
    e = F.col("embedding")
    fine = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_finite(e) & (F.size(e) > 0))
    one = F.struct(label.cast("int").alias("label"), whole_numbers(e, SCALE, REACH).alias("q"))
    once = fine.select(F.col("vec_id").cast("bigint").alias("vec_id"), one.alias("one")).groupBy("vec_id").agg(F.min("one").alias("one"))
    q = F.col("one.q")
    norm = F.sqrt(F.aggregate(q, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return once.select("vec_id", "one.label", F.size(q).alias("dim"), q.alias("q"), norm.alias("norm"))


def spanning_order(x: np.ndarray):
    """(row, place of its parent, edge length) in the order of a minimum spanning tree from the row nearest to the mean."""
    n = len(x)
    root = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order, place = [(root, -1, 0.0)], {root: 0}
    near, via, left = ((x - x[root]) ** 2).sum(1), np.full(n, root), np.ones(n, bool)
    left[root] = False
    while left.any():
        at = int(np.where(left, near, np.inf).argmin())
        order.append((at, place[int(via[at])], float(np.sqrt(near[at]))))
        place[at] = len(place)
        left[at] = False
        d = ((x - x[at]) ** 2).sum(1)
        closer = d < near
        near[closer], via[closer] = d[closer], at
    return order


def trees(anchors: DataFrame) -> DataFrame:
    """``anchors`` (vec_id, label, dim, q, and more) with block, place, parent and edge.

    A block's anchors share the signs of a few random projections; a larger cell is cut by a hash of the id, so a block
    holds about ``BLOCK`` whatever the anchors are.
    """
    n = anchors.count()
    bits = max(0, int(np.log2(max(1, n / BLOCK))))

    def coded(batches):
        import pyarrow as pa

        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            code = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                at = np.nonzero(dims == dim)[0]
                x = matrix(batch.column(batch.schema.get_field_index("q")).take(pa.array(at)), dim, float)
                signs = x @ np.random.default_rng([SEED, dim]).normal(size=(dim, bits)) > 0
                code[at] = signs @ (1 << np.arange(bits, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=[*batch.schema.names, "code"])

    known = materialize(anchors.mapInArrow(coded, T.StructType([*anchors.schema.fields, T.StructField("code", T.LongType())])), "coded")
    parts = known.groupBy("dim", "code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    cut = known.join(parts, ["dim", "code"]).withColumn("block", F.struct("code", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"))).select(*anchors.columns, F.xxhash64("block").alias("block"))
    schema = T.StructType([*cut.schema.fields, T.StructField("place", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("edge", T.DoubleType())])

    def grow(pdf):
        pdf = pdf.sort_values("vec_id")
        order = spanning_order(np.array(pdf["q"].tolist(), float))
        out = pdf.iloc[[o[0] for o in order]].copy()
        out["place"], out["parent"], out["edge"] = np.arange(len(order)), [o[1] for o in order], [o[2] for o in order]
        return out

    return cut.groupBy("dim", "block").applyInPandas(grow, schema)


def stretches(batches, keys: int):
    """(key, batch) of each stretch of rows that agree in the first ``keys`` columns, whole across batches."""
    import pyarrow as pa

    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        bounds = [0, *(np.nonzero((key[:, 1:] != key[:, :-1]).any(0))[0] + 1).tolist(), batch.num_rows]
        for s, t in zip(bounds, bounds[1:]):
            mine = tuple(key[:, s].tolist())
            if current is not None and mine != current:
                yield current, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            current = mine
            held.append(batch.slice(s, t - s))
    if held:
        yield current, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def best_of(score: np.ndarray, ids: np.ndarray, at: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` of the positions ``at`` by falling score, ties to the smaller id."""
    if len(at) > top:
        at = at[score[at] >= np.partition(score[at], len(at) - top)[len(at) - top]]
    return at[np.lexsort((ids[at], -score[at]))[:top]]


def _floor_of(low: np.ndarray, sure: np.ndarray, top: int) -> float:
    """A score that ``top`` of the ``sure`` rows reach, or minus infinity if they are fewer."""
    held = low[sure]
    return np.partition(held, len(held) - top)[len(held) - top] if len(held) >= top else -np.inf


def positive_need(low, high, kin, top: int) -> np.ndarray:
    """Rows that may be among the ``top`` of the rows ``kin``."""
    return kin & (high >= _floor_of(low, kin, top))


def window_need(low, high, other, bounds, top: int) -> np.ndarray:
    """Rows of ``other`` that may be among the ``top`` best within any of the ``bounds``."""
    need = np.zeros(len(low), bool)
    for first, last in bounds:
        sure = other & (low >= first) & (high <= last)
        need |= (low <= last) & (high >= max(first, _floor_of(low, sure, top)))
    return need & other


def walk(block, ids, labels, q, norms, needs, take):
    """Scores a block's anchors in tree order; ``needs`` says which rows an anchor asks for, ``take`` gets their scores.

    Returns how many scores were taken.
    """
    dim = q.shape[1]
    a = matrix(block.column("q"), dim)
    parent, edge = block.column("parent").to_numpy(), block.column("edge").to_numpy()
    small = dim * max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(q).max(initial=0))) < EXACT
    x = q.astype(float) if small else q  # sums of whole numbers below 2^53 are exact as doubles
    a = a.astype(float) if small else a
    low, high, scored = [], [], 0
    last_use = {int(p): i for i, p in enumerate(parent.tolist())}  # the last child of each place
    for i in range(len(a)):
        if parent[i] < 0:
            lo, hi = np.full(len(x), -np.inf), np.full(len(x), np.inf)
        else:
            slack = edge[i] * norms * (1 + 1e-9) + 1e-6 * (1 + np.abs(low[parent[i]]))
            lo, hi = low[parent[i]] - slack, high[parent[i]] + slack
        need = needs(i, lo, hi) if parent[i] >= 0 else np.ones(len(x), bool)
        at = np.nonzero(need)[0]
        exact = (x[at] if len(at) < len(x) else x) @ a[i]
        scored += len(at)
        lo[at] = hi[at] = exact
        take(i, at, lo)
        low.append(lo)
        high.append(hi)
        if parent[i] >= 0 and last_use.get(int(parent[i])) == i:
            low[parent[i]] = high[parent[i]] = None
    return scored


def _met(rows: DataFrame, asked: DataFrame, extra: list[str], visit, schema: str) -> DataFrame:
    """Every block of ``asked`` with every chunk of ``rows``; ``visit(candidates, block)`` gives what a meeting finds."""
    counts = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    here = rows.join(counts, "dim").withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "vec_id"), F.col("chunks")).cast("int"))
    there = asked.join(counts, "dim").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tree = {"block": "bigint", "place": "int", "parent": "int", "edge": "double"}
    kinds = {**tree, **{c: asked.schema[c].dataType.simpleString() for c in extra}}
    own = ["dim", "chunk", "block", "anchor", "place", "vec_id", "label", "q", "norm", "parent", "edge", *extra]
    here = here.withColumn("anchor", F.lit(False)).withColumns({c: F.lit(0).cast(t) if c in tree else F.lit(None).cast(t) for c, t in kinds.items()})
    # candidates come before all blocks of their chunk
    both = here.select(F.lit(False).alias("_k"), *own).union(there.withColumn("anchor", F.lit(True)).select(F.lit(True).alias("_k"), *own))
    both = both.select("dim", "chunk", "_k", "block", *own[3:])

    def run(batches):
        import pyarrow as pa

        held, of = None, None
        for (dim, chunk, is_block, _), part in stretches(batches, 4):
            if not is_block:
                held, of = (part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("q"), int(dim)), part.column("norm").to_numpy()), (dim, chunk)
            elif of == (dim, chunk):
                found = visit(held, part)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=names)

    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    return both.repartition("dim", "chunk").sortWithinPartitions("dim", "chunk", "_k", "block", "place").mapInArrow(run, schema)


def _joined(found):
    """Columns of the meetings' tuples of columns."""
    return [np.concatenate(c) for c in zip(*found)]


def _positives(rows: DataFrame, anchors: DataFrame, top: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): each anchor's best other rows of its label."""
    def visit(held, block):
        ids, labels, q, norms = held
        own, label = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
        kin = lambda i: (labels == label[i]) & (ids != own[i])
        found = [(np.zeros(0, np.int64),) * 3]

        def take(i, at, score):
            best = best_of(score, ids, at[kin(i)[at]], top)
            found.append((np.full(len(best), own[i]), ids[best], score[best].astype(np.int64)))

        walk(block, ids, labels, q, norms, lambda i, lo, hi: positive_need(lo, hi, kin(i), top), take)
        return _joined(found)

    got = _met(rows, anchors, [], visit, "anchor_id bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    return got.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top).drop("_r")


def _negatives(rows: DataFrame, anchors: DataFrame, window: tuple[int, int], top: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, negative_id, negative_score): the best rows of other labels in each positive's window."""
    def visit(held, block):
        ids, labels, q, norms = held
        own, label, pairs = block.column("vec_id").to_numpy(), block.column("label").to_numpy(), block.column("pairs").to_pylist()
        bounds = [[(-(-window[0] * p["positive_score"] // 100), window[1] * p["positive_score"] // 100) for p in some] for some in pairs]
        found = [(np.zeros(0, np.int64),) * 5]

        def take(i, at, score):
            at = at[(labels[at] != label[i]) & (ids[at] != own[i])]
            for p, (first, last) in zip(pairs[i], bounds[i]):
                best = best_of(score, ids, at[(score[at] >= first) & (score[at] <= last)], top)
                if len(best):
                    whole = np.full(len(best), 1, np.int64)
                    found.append((whole * own[i], whole * p["positive_id"], whole * p["positive_score"], ids[best], score[best].astype(np.int64)))

        walk(block, ids, labels, q, norms, lambda i, lo, hi: window_need(lo, hi, labels != label[i], bounds[i], top), take)
        return _joined(found)

    got = _met(rows, anchors, ["pairs"], visit, "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return got.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def mine(vectors: DataFrame, label: Column | None = None, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
         window: tuple[int, int] = WINDOW) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    Anchors are the rows whose id ``every`` divides.  A row's score is its inner product with the anchor in whole numbers,
    floor(256 * x) of each component; higher scores come first, ties go to the smaller id.  An anchor's positives are its first
    ``positives`` other rows of the same label (``label``, the column of that name if not given), and a positive's negatives the first ``negatives`` rows
    of other labels with ``window[0]`` * positive <= 100 * negative <= ``window[1]`` * positive.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part.  An id names one row: of rows that repeat one,
    that with the smallest label and vector stays.  Vectors of different lengths do not meet.  Zero vectors take part.  Components
    beyond 2^22 after scaling count as 2^22, exact for vectors of up to 4096 components.  Other columns are not read; empty tables give no rows.
    """
    rows = materialize(prepared(vectors, F.col("label") if label is None else label), "rows")
    anchors = materialize(trees(rows.filter(F.col("vec_id") % every == 0)), "trees")
    best = materialize(_positives(rows, anchors, positives), "positives")
    pairs = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("pairs"))  # at most ``positives``
    # an anchor without positives keeps its place in the tree
    asked = anchors.join(pairs, "vec_id", "left").withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<positive_id:bigint,positive_score:bigint>>")))
    return _negatives(rows, asked, window, negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.vec_id AS a, v.vec_id AS b, a.label = v.label AS kin, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id AND len(a.q) = len(v.q) WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT a, b, score FROM s WHERE kin QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {POSITIVES}),
n AS (SELECT p.a, p.b, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS k
  FROM p JOIN s ON p.a = s.a AND NOT s.kin AND {WINDOW[0]} * p.score <= 100 * s.score AND 100 * s.score <= {WINDOW[1]} * p.score)
SELECT a AS anchor_id, b AS positive_id, CAST(k AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= {NEGATIVES}
"""
