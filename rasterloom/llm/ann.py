"""Nearest neighbours by inner product with cross-polytope hashing.

Rows are cut into bands of similar norm.  Each band is scaled to its own largest norm and lifted to the unit
sphere by one more coordinate, so that the largest inner product is the nearest direction and the lifting
coordinate stays small, however uneven the norms of the table are; a query looks into every band.  A table turns them by three rounds of random signs and
a fast Hadamard transform; a vector's cell is the signed axis that it is nearest to.  A query
looks into the ``PROBES`` cells of each of ``TABLES`` tables whose axes it is nearest to, and what it finds is ranked by the
exact inner product of the original vectors.  Cells are cut into blocks of bounded size; a query that
found too few rows is asked again over all cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.vectors import VECTOR_ROWS, tamed, usable
from rasterloom.session import materialize

TABLES = 4
PROBES = 0.28  # share of a table's cells that a query looks into
ROUNDS = 3
TOP = 20
EVERY = 20  # rows whose id it divides are queries
SEED = 11
GROUP = 32  # cells that travel together
BAND = 1.2  # largest norm of a band over its smallest


def padded(dim: int) -> int:
    """Least power of two that holds ``dim`` coordinates and the lifting one."""
    return 1 << dim.bit_length()


def turned(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-random rotation: rounds of sign flips and a Hadamard transform over the last axis."""
    n, size = x.shape
    rng = np.random.default_rng([SEED, table, size])
    for _ in range(ROUNDS):
        x = x * rng.choice([-1.0, 1.0], size)
        step = 1
        while step < size:
            pairs = x.reshape(n, size // (2 * step), 2, step)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
            step *= 2
        x = x / np.sqrt(size)
    return x


def lifted(x: np.ndarray, longest: np.ndarray | None) -> np.ndarray:
    """Unit vectors of the padded size: rows with the lifting coordinate, or queries (``longest`` None) with 0 there.

    ``longest`` is the logarithm of the largest norm of each row's band, as a column.
    """
    near, power = tamed(x)
    norm = np.sqrt((near * near).sum(1, keepdims=True))
    share = 1.0 if longest is None else np.minimum(1.0, np.exp(np.log(norm) + power[:, None] * np.log(2.0) - longest))
    out = np.zeros((len(x), padded(x.shape[1])))
    out[:, :x.shape[1]] = near / norm * share
    if longest is not None:
        out[:, x.shape[1]:x.shape[1] + 1] = np.sqrt(np.maximum(0, 1 - share ** 2))
    return out


def cells(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The ``probes`` signed axes nearest to each row: 0.. for positive ends, size.. for negative ones."""
    t = turned(x, table)
    both = np.concatenate([t, -t], axis=1)
    if probes == 1:
        return both.argmax(1)[:, None]
    if probes >= both.shape[1]:
        return np.broadcast_to(np.arange(both.shape[1]), both.shape)
    return np.argpartition(-both, probes - 1, axis=1)[:, :probes]


def _measured(base: DataFrame) -> DataFrame:
    """``base`` (vec_id, dim, e) with the logarithm of each vector's norm."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            dims, norm = batch.column(1).to_numpy(), np.zeros(batch.num_rows)
            for dim in np.unique(dims).tolist():
                at = np.nonzero(dims == dim)[0]
                near, power = tamed(np.array(batch.column(2).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), "<f8").reshape(len(at), dim))
                norm[at] = np.log((near * near).sum(1)) / 2 + power * np.log(2.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm)], names=["vec_id", "dim", "e", "norm"])

    return base.select("vec_id", "dim", "e").mapInArrow(run, f"vec_id bigint, dim int, e {base.schema['e'].dataType.simpleString()}, norm double")


def _banded(base: DataFrame) -> DataFrame:
    """``base`` with its norm band, cut by value so that norms about 1 share one, and the logarithm of the band's largest norm."""
    rows = materialize(_measured(base), "measured")
    rows = rows.withColumn("band", F.floor(F.col("norm") / float(np.log(BAND)) + 0.5).cast("int"))
    # A row per band and length of vectors: doubles span under 8000 bands.
    longest = F.broadcast(materialize(rows.groupBy("dim", "band").agg(F.max("norm").alias("longest")), "bands"))
    return rows.drop("norm").join(longest, ["dim", "band"])


def _hashed(vectors: DataFrame, tables: int, probes: float, query: bool) -> DataFrame:
    """(dim, band, group, cells, query, vec_id, e): a row per table, or per group of cells with a probed one.

    ``cells`` is the cell's place in its group, or, for a query, the bits of its probed cells there.  A query's cells
    are the same in every band; its own band is not used.
    """
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.nonzero(dims == dim)[0]
                e = batch.column(2).take(pa.array(at))
                x = np.array(e.flatten().to_numpy(zero_copy_only=False), "<f8").reshape(len(at), dim)
                bands = batch.column(3).to_numpy()[at]
                up, axes = lifted(x, None if query else batch.column(4).to_numpy()[at][:, None]), 2 * padded(dim)
                groups = -(-axes // GROUP)
                for table in range(tables):
                    hit = cells(up, table, max(1, round(probes * axes)) if query else 1)
                    if query:
                        asked = np.zeros((len(at), groups * GROUP), np.int64)
                        np.put_along_axis(asked, hit, 1, axis=1)
                        bits = (asked.reshape(len(at), groups, GROUP) << np.arange(GROUP)).sum(2)
                        rows, group = np.nonzero(bits)
                        place = bits[rows, group]
                    else:
                        rows, group, place = np.arange(len(at)), hit[:, 0] // GROUP, hit[:, 0] % GROUP
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(rows), dim, np.int32)), pa.array(bands[rows]), pa.array((group + table * groups).astype(np.int32)), pa.array(place.astype(np.int64)),
                        pa.array(np.full(len(rows), query)), pa.array(ids[at][rows]), e.take(pa.array(rows))],
                        names=["dim", "band", "group", "cells", "query", "vec_id", "e"])

    kind = vectors.schema["e"].dataType.simpleString()
    return vectors.select("vec_id", "dim", "e", "band", "longest").mapInArrow(run, f"dim int, band int, group int, cells bigint, query boolean, vec_id bigint, e {kind}")


def block_best(q_ids, q, bits, r_ids, r, cell, top: int):
    """(query position, row position, exact score) of each query's best rows among its probed cells, itself excepted.

    Ties go to the smaller id.
    """
    s = np.full((len(q), len(r)), -np.inf)
    order = np.argsort(cell, kind="stable")
    r_ids, r, cell = r_ids[order], r[order], cell[order]
    starts = np.nonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))[0]
    for a, b in zip(starts, [*starts[1:], len(cell)]):
        asks = np.nonzero(bits >> cell[a] & 1)[0]
        s[asks, a:b] = q[asks] @ r[a:b].T
    s[(q_ids[:, None] == r_ids[None, :]) | np.isnan(s)] = -np.inf  # a sum of infinite products of both signs has no place
    k = min(top, len(r))
    floor = np.partition(s, len(r) - k, axis=1)[:, len(r) - k]
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)))
    qi, ri = np.nonzero((s >= (floor - slack)[:, None]) & (s > -np.inf))
    exact = (q[qi] * r[ri]).sum(1)
    best = np.lexsort((r_ids[ri], -exact, qi))
    qi, ri, exact = qi[best], ri[best], exact[best]
    first = np.arange(len(qi)) - np.searchsorted(qi, qi) < top
    return qi[first], order[ri[first]], exact[first]


def _best(hashed: DataFrame, top: int) -> DataFrame:
    """(query_id, vec_id, score): the best rows of each query, by batches of blocks; rows come sorted by block."""
    def run(batches):
        import pandas as pd
        import pyarrow as pa

        found: list[pd.DataFrame] = []

        def solve(part):
            asks = part["query"].to_numpy()
            q, r = part[asks], part[~asks]
            for lo in range(0, len(q), VECTOR_ROWS if len(r) else len(q) + 1):
                few = q.iloc[lo:lo + VECTOR_ROWS]
                if len(r):
                    q_ids, r_ids = few["vec_id"].to_numpy(), r["vec_id"].to_numpy()
                    qi, ri, score = block_best(q_ids, np.array(few["e"].tolist(), float), few["cells"].to_numpy(), r_ids, np.array(r["e"].tolist(), float),
                                               r["cells"].to_numpy(), top)
                    found.append(pd.DataFrame({"query_id": q_ids[qi], "vec_id": r_ids[ri], "score": score}))

        def merged():
            """What the blocks so far have found, cut to each query's best."""
            got = pd.concat(found).drop_duplicates(["query_id", "vec_id"]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            found.clear()
            return pa.RecordBatch.from_pandas(got[got.groupby("query_id").cumcount() < top], preserve_index=False)

        held = None
        for batch in batches:
            pdf = batch.to_pandas() if held is None else pd.concat([held, batch.to_pandas()], ignore_index=True)
            key = pdf[["dim", "band", "group", "qs", "rs"]].to_numpy()
            bounds = [0, *(np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1).tolist()]
            for s, t in zip(bounds, bounds[1:]):
                solve(pdf.iloc[s:t])
            held = pdf.iloc[bounds[-1]:]
            if sum(map(len, found)) > 1 << 20:
                yield merged()
        if held is not None:
            solve(held)
        if found:
            yield merged()

    return hashed.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def _found(rows: DataFrame, queries: DataFrame, tables: int, probes: float, top: int) -> DataFrame:
    index, asked = _hashed(rows, tables, 1, False), _hashed(queries, tables, probes, True).drop("band")
    # A row per group of cells: at most tables * 2 * padded(dim) / GROUP, rounded up, for each length of vectors and band.
    held = index.groupBy("dim", "band", "group").agg(F.ceil(F.count(F.lit(1)) / VECTOR_ROWS).cast("int").alias("nr"))
    asks = asked.groupBy("dim", "group").agg(F.ceil(F.count(F.lit(1)) / VECTOR_ROWS).cast("int").alias("nq"))
    grid = F.broadcast(materialize(held.join(asks, ["dim", "group"]), "groups"))
    salt = F.xxhash64(F.lit("block"), "vec_id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = index.join(grid, ["dim", "band", "group"]).withColumn("rs", F.pmod(salt, F.col("nr")).cast("int")).withColumn("qs", every("nq"))
    asked = asked.join(grid, ["dim", "group"]).withColumn("qs", F.pmod(salt, F.col("nq")).cast("int")).withColumn("rs", every("nr"))
    cols = ["dim", "band", "group", "qs", "rs", "query", "cells", "vec_id", "e"]
    key = cols[:5]
    return _best(index.select(*cols).union(asked.select(*cols)).repartition(*key).sortWithinPartitions(*key), top)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = EVERY, top: int = TOP, tables: int = TABLES, probes: float = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of each row whose id ``every`` divides.

    Nearness is the inner product in double precision; ties go to the smaller id; a row is no neighbour of
    itself (rows that repeat an id are one another's self).  Products beyond the range of doubles count as infinite, and pairs whose infinite products cancel do not meet.  Vectors that are null, zero or hold null
    or non-finite numbers take no part, nor do null ids; vectors of different lengths do not meet.
    A query with fewer than ``top`` candidates in all gets all of them.
    """
    base = materialize(_banded(usable(vectors)), "banded")
    queries = base.filter(F.col("vec_id") % every == 0)
    first = materialize(_ranked(_found(base, queries, tables, probes, top), top), "found")
    held = base.groupBy("dim").agg(F.count_distinct("vec_id").alias("n"))
    short = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("got"))
    wanting = queries.join(held, "dim").join(short, queries.vec_id == short.query_id, "left")
    wanting = materialize(wanting.filter(F.coalesce("got", F.lit(0)) < F.least(F.lit(top), F.col("n") - 1)).select("vec_id", "dim", "e", "band", "longest"), "wanting")
    if wanting.isEmpty():
        return first
    again = _ranked(_found(base, wanting, 1, 1.0, top), top)
    rest = first.join(wanting.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti")
    return rest.unionByName(again)
