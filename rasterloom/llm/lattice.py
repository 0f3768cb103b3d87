"""Near-copies of embeddings by E8 lattice hashing.

A table projects unit vectors to eight random orthogonal directions, scales them and decodes them to the
nearest point of the E8 lattice: the vector's home cell.  It also visits the ``PROBES`` neighbouring cells
whose points are next nearest.  Two vectors meet in a cell that is home to one and home or visited to the
other.  What meets is compared by exact cosine inside the cell, in blocks of bounded size; a block gives
link counts and a star of edges for each of its components, never its pairs.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import connected
from rasterloom.llm.vectors import VECTOR_ROWS, is_usable, tamed, usable
from rasterloom.session import materialize

NEAR = 0.95
TABLES = 10
PROBES = 8
SCALE = 3.0  # of the projection, in units of the lattice
SEED = 5
PAIRS = 1 << 18  # linked pairs handled at once


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1.0, 1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) / 2 for s in product((-1.0, 1.0), repeat=8) if np.prod(s) > 0]
    return np.array(whole + half)


ROOTS = roots()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.nonzero(near.sum(1).astype(np.int64) % 2)[0]
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of the even integer points and their copy shifted by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y`` summed in the order of the inner axis, so that a row's values don't depend on the rows beside it."""
    out = np.zeros((x.shape[0], y.shape[1]))
    for k in range(x.shape[1]):
        out += x[:, k:k + 1] * y[k]
    return out


def cell_keys(unit: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """Keys (n, tables, 1 + probes) of each vector's home cell and visited cells."""
    n, dim = unit.shape
    out = np.zeros((n, tables, 1 + probes), np.int64)
    for table in range(tables):
        rng = np.random.default_rng([SEED, table, dim])
        basis = np.linalg.qr(rng.normal(size=(max(dim, 8), 8)))[0][:dim]
        weights = rng.integers(1, 1 << 62, 9, dtype=np.int64) | 1
        x = dots(unit, basis * (SCALE * np.sqrt(max(dim, 8) / 8)))
        home = decode(x)
        toward = np.argsort(-dots(x - home, ROOTS.T), axis=1, kind="stable")[:, :probes]
        points = np.concatenate([home[:, None], home[:, None] + ROOTS[toward]], axis=1)
        with np.errstate(over="ignore"):
            out[:, table] = (np.rint(2 * points).astype(np.int64) * weights[:8]).sum(2) * weights[8] + table
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    x, _ = tamed(x)
    return x / np.sqrt(dots(x * x, np.ones((x.shape[1], 1))))


def _meets_here(here, keys_a, keys_b) -> np.ndarray:
    """Whether ``here`` is the first cell at which each pair meets: by table, a's home before b's."""
    at_a = (keys_b == keys_a[:, :, :1]).any(2)
    at_b = (keys_a == keys_b[:, :, :1]).any(2)
    cells = np.where(at_a, keys_a[:, :, 0], keys_b[:, :, 0])
    return cells[np.arange(len(cells)), (at_a | at_b).argmax(1)] == here


def block_links(here: int, ids, unit, home, left, right, near: float, tables: int, probes: int):
    """Links of a block: (row, other row) positions of the pairs of rows ``left`` by rows ``right``, and which count here.

    At least one of two rows has its home here.  A pair that meets in several cells counts in the first.
    """
    found = []
    step = max(1, (1 << 22) // max(1, len(right)))
    for at in range(0, len(left), step):
        rows = left[at:at + step]
        cosine = unit[rows] @ unit[right].T
        i, j = np.nonzero(cosine >= near - 1e-9)
        close = cosine[i, j] < near + 1e-9
        i, j = rows[i], right[j]
        ok = (home[i] | home[j]) & (ids[i] < ids[j] if left is right else ids[i] != ids[j])
        if close.any():  # on the border the sum's order decides, so it is fixed
            ok[close] &= (unit[i[close]] * unit[j[close]]).sum(1) >= near
        i, j = i[ok], j[ok]
        swap = ids[i] > ids[j]
        found.append((np.where(swap, j, i), np.where(swap, i, j)))
    a, b = (np.concatenate(side) for side in zip(*found))
    if not len(a):
        return a, b, np.zeros(0, bool)
    rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    keys = cell_keys(unit[rows], tables, probes)
    at_a, at_b = place[:len(a)], place[len(a):]
    first = [_meets_here(here, keys[at_a[p:p + PAIRS]], keys[at_b[p:p + PAIRS]]) for p in range(0, len(a), PAIRS)]
    return a, b, np.concatenate(first)


def star(ids, a, b) -> np.ndarray:
    """Smallest id that each row reaches over the pairs (a, b)."""
    order = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), np.int64)
    label[order] = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if np.array_equal(new, label):
            return ids[order][label]
        label = new


def _visits(nodes: DataFrame, tables: int, probes: int) -> DataFrame:
    """(dim, cell, home, vec_id): a row for each vector and each cell that it has or visits."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.nonzero(dims == dim)[0]
                x = np.array(batch.column(2).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), "<f8").reshape(len(at), dim)
                keys = cell_keys(unit_rows(x), tables, probes)
                home = np.zeros(keys.shape, bool)
                home[:, :, 0] = True
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(keys.size, dim, np.int32)), pa.array(keys.reshape(-1)), pa.array(home.reshape(-1)),
                    pa.array(np.repeat(ids[at], tables * (1 + probes)))], names=["dim", "cell", "home", "vec_id"])

    return nodes.select("vec_id", "dim", "e").mapInArrow(run, "dim int, cell bigint, home boolean, vec_id bigint")


COLUMNS = ("cell", "c1", "c2", "chunk", "home", "vec_id", "weight")


def _stretches(batch):
    """(dim, columns, unit vectors) of each stretch of rows with vectors of one length."""
    dims = batch.column(0).to_numpy()
    values = np.asarray(batch.column(len(COLUMNS) + 1).flatten().to_numpy(zero_copy_only=False), float)
    ends = np.concatenate([[0], np.cumsum(dims)])
    cuts = [0, *(np.nonzero(dims[1:] != dims[:-1])[0] + 1).tolist(), len(dims)]
    for s, t in zip(cuts, cuts[1:]):
        if t > s:
            cols = {c: batch.column(i).to_numpy(zero_copy_only=False)[s:t] for i, c in enumerate(COLUMNS, 1)}
            yield int(dims[s]), cols, unit_rows(values[ends[s]:ends[t]].reshape(t - s, int(dims[s])))


def _compared(blocks: DataFrame, near: float, tables: int, probes: int) -> DataFrame:
    """(vec_id, n, low): link counts and block components of the rows that link with any; rows come sorted by block."""
    def solve(cols, unit, s, t):
        """Links of the block in rows s..t, if it has any."""
        one = cols["c1"][s] == cols["c2"][s]
        part = unit[s:t]
        if t - s < 2 or one and t - s <= VECTOR_ROWS and np.count_nonzero(part @ part.T >= near - 1e-9) <= t - s:
            return None  # each row is near itself alone
        ids, chunk, weight = (cols[c][s:t] for c in ("vec_id", "chunk", "weight"))
        left = np.nonzero(chunk == cols["c1"][s])[0]
        right = left if one else np.nonzero(chunk == cols["c2"][s])[0]
        a, b, first = block_links(int(cols["cell"][s]), ids, part, cols["home"][s:t], left, right, near, tables, probes)
        if not len(a):
            return None
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, a[first], weight[b[first]])
        np.add.at(count, b[first], weight[a[first]])
        linked = np.zeros(len(ids), bool)
        linked[a] = linked[b] = True
        return ids[linked], count[linked], star(ids, a, b)[linked]

    def run(batches):
        import pyarrow as pa

        def rows_of(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["vec_id", "n", "low"])

        dim, held, unit = None, None, None
        for batch in batches:
            found = []
            for new_dim, cols, vectors in _stretches(batch):
                if held is not None and new_dim == dim:
                    cols, vectors = {c: np.concatenate([held[c], cols[c]]) for c in COLUMNS}, np.concatenate([unit, vectors])
                elif held is not None:
                    found.append(solve(held, unit, 0, len(unit)))
                key = np.stack([cols[c] for c in ("cell", "c1", "c2")])
                bounds = [0, *(np.nonzero((key[:, 1:] != key[:, :-1]).any(0))[0] + 1).tolist()]
                found += [solve(cols, vectors, s, t) for s, t in zip(bounds, bounds[1:])]
                dim, held, unit = new_dim, {c: cols[c][bounds[-1]:] for c in COLUMNS}, vectors[bounds[-1]:]
            found = [f for f in found if f is not None]
            if found:
                yield rows_of(found)
        last = solve(held, unit, 0, len(unit)) if held is not None else None
        if last is not None:
            yield rows_of([last])

    return blocks.select("dim", *COLUMNS, "e").mapInArrow(run, "vec_id bigint, n bigint, low bigint")


def near_copies(vectors: DataFrame, near: float = NEAR, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Links are pairs of rows with cosine of at least ``near`` in double precision.  Rows with equal vectors
    are one node that counts as many times as it has rows, so a large group of copies costs one comparison.
    Vectors that are null, zero or hold null or non-finite numbers link with nothing and are their own
    component, as are rows without an id, whose component is null; vectors of different lengths do
    not link.  Ids are taken to name one vector: rows that repeat an id and differ in their vectors share
    their links.  kept is vec_id = component_id, and true for a null id.
    """
    base = materialize(usable(vectors), "vectors")
    nodes = materialize(base.groupBy("dim", "e").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight")), "distinct")
    nodes = nodes.withColumnRenamed("node", "vec_id")
    visits = materialize(_visits(nodes, tables, probes), "visits")
    sizes = visits.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("rows"), F.max("home").alias("homes")).filter("rows > 1 and homes")
    cut = visits.join(sizes, ["dim", "cell"]).withColumn("chunks", F.ceil(F.col("rows") / VECTOR_ROWS).cast("int"))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.select("dim", "cell", "home", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "chunk", "vec_id")
    kind = vectors.schema["embedding"].dataType  # vectors travel in the width that they came in
    cut = cut.join(nodes.select("vec_id", "weight", F.col("e").cast(kind).alias("e")), "vec_id")
    order = ["dim", "cell", "c1", "c2"]
    got = materialize(_compared(cut.repartition(*order).sortWithinPartitions(*order), near, tables, probes), "links")
    counts = got.groupBy("vec_id").agg(F.sum("n").alias("n"))
    named = connected(got.filter("low <> vec_id").select(F.col("vec_id").alias("u"), F.col("low").alias("v")))
    facts = nodes.join(counts, "vec_id", "left").join(named.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    facts = facts.select("dim", "e", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    linked = base.join(facts, ["dim", "e"]).select("vec_id", "n_links", "component_id")
    apart = vectors.select("vec_id", "embedding").withColumn("_ok", is_usable(F.col("embedding")) & F.col("vec_id").isNotNull()).filter(~F.coalesce("_ok", F.lit(False)))
    apart = apart.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(apart).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
