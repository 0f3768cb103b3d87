"""Skeletons, widths and convex hulls of regions, tile by tile.

No region is gathered whole: thinning and distances run on tiles with a halo and repeat
only while a halo proved too small; hulls are first reduced to their vertices.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import regions as G
from rasterloom.session import by_key_stream, materialize
from rasterloom.operators.regions import KEY

THIN_TILE, THIN_HALO = 512, 64


def _tiled_runs(runs: DataFrame, tile: int, halo: int) -> DataFrame:
    """Run pieces for every tile whose window (tile plus halo) they meet."""
    def reach(lo, hi):
        return F.sequence(F.floor((lo - halo) / tile).cast("int"), F.floor((hi + halo) / tile).cast("int"))

    t = runs.withColumn("ty", F.explode(reach(F.col("y"), F.col("y")))).withColumn("tx", F.explode(reach(F.col("x0"), F.col("x1"))))
    t = t.filter((F.col("ty") >= 0) & (F.col("tx") >= 0) & (F.col("ty") * tile < F.col("fh")) & (F.col("tx") * tile < F.col("fw")))
    lo, hi = F.col("tx") * tile - halo, F.col("tx") * tile + tile + halo - 1
    return t.withColumns({"x0": F.greatest("x0", lo), "x1": F.least("x1", hi)})


def _paint(pdf, tile, halo):
    """Label codes of one window, 0 = background, and the region of each code."""
    oy, ox = int(pdf["ty"].iloc[0]) * tile - halo, int(pdf["tx"].iloc[0]) * tile - halo
    ids, code = np.unique(pdf["region_id"].to_numpy(), return_inverse=True)
    a = np.zeros((tile + 2 * halo, tile + 2 * halo), dtype=np.int32)
    for y, x0, x1, c in zip(pdf["y"].to_numpy() - oy, pdf["x0"].to_numpy() - ox, pdf["x1"].to_numpy() - ox, code):
        a[y, x0:x1 + 1] = c + 1
    return a, ids, oy, ox


def thin(mask: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Two-subiteration parallel thinning; also the pixels removed in the last pass if passes ran out."""
    m = np.pad(mask.astype(np.uint8), 1)
    last = np.zeros_like(mask, dtype=bool)
    for k in range(passes):
        before = m.copy()
        for first in (True, False):
            p = [m[:-2, 1:-1], m[:-2, 2:], m[1:-1, 2:], m[2:, 2:], m[2:, 1:-1], m[2:, :-2], m[1:-1, :-2], m[:-2, :-2]]
            count = sum(q.astype(np.int8) for q in p)
            turns = sum(((p[i] == 0) & (p[(i + 1) % 8] == 1)).astype(np.int8) for i in range(8))
            n, e, s, w = p[0], p[2], p[4], p[6]
            c1, c2 = (n * e * s, e * s * w) if first else (n * e * w, n * s * w)
            drop = (m[1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (turns == 1) & (c1 == 0) & (c2 == 0)
            m[1:-1, 1:-1][drop] = 0
        changed = (before != m)[1:-1, 1:-1]
        if not changed.any():
            return m[1:-1, 1:-1].astype(bool), last
        if k == passes - 1:
            last = changed
    return m[1:-1, 1:-1].astype(bool), last


def skeleton(labelled: DataFrame, tile: int = THIN_TILE, halo: int = THIN_HALO) -> DataFrame:
    """Skeleton pixels ``(image_id, region_id, y, x)`` of all regions.

    One pass of a tile runs ``halo / 2`` thinning steps, which is as far as its halo is
    trustworthy; the pass repeats on the thinned mask while any tile was still changing.
    """
    kind = dict(labelled.dtypes)["image_id"]
    runs = labelled.select("image_id", "fh", "fw", "region_id", "y", "x0", "x1")

    def work(pdf):
        import pandas as pd

        a, ids, oy, ox = _paint(pdf, tile, halo)
        skel, busy = thin(a > 0, halo // 2)
        core = (slice(halo, halo + tile), slice(halo, halo + tile))
        yy, xx = np.nonzero(skel[core])
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "fh": pdf["fh"].iloc[0], "fw": pdf["fw"].iloc[0],
                             "region_id": ids[a[core][yy, xx] - 1], "y": yy + oy + halo, "x0": xx + ox + halo, "x1": xx + ox + halo,
                             "busy": bool(busy[core].any())})

    schema = f"image_id {kind}, fh int, fw int, region_id bigint, y int, x0 int, x1 int, busy boolean"
    while True:
        out = materialize(_tiled_runs(runs, tile, halo).groupBy("image_id", "ty", "tx").applyInPandas(work, schema), "skeleton")
        if out.filter("busy").isEmpty():
            return out.select("image_id", "region_id", "y", F.col("x0").alias("x"))
        runs = out.drop("busy")


def skeleton_stats(skel: DataFrame) -> DataFrame:
    """Length, branch points, endpoints and end-to-end distance of every skeleton."""
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    near = skel.withColumn("_o", F.explode(around)).select(*KEY, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"))
    deg = near.groupBy(*KEY, "y", "x").agg(F.count(F.lit(1)).alias("_n"))
    j = skel.join(deg, KEY + ["y", "x"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    end = F.when(F.col("_n") == 1, F.struct("y", "x"))
    s = j.groupBy(*KEY).agg(F.count(F.lit(1)).alias("skeleton_length"), F.count_if(F.col("_n") >= 3).alias("branch_points"),
                            F.count_if(F.col("_n") == 1).alias("endpoints"), F.min(end).alias("_a"), F.max(end).alias("_b"))
    dist = F.hypot(F.col("_a.y") - F.col("_b.y"), F.col("_a.x") - F.col("_b.x"))
    simple = (F.col("endpoints") == 2) & (F.col("branch_points") == 0) & (F.col("skeleton_length") > 1) & (dist > 0)
    return s.select(*KEY, "skeleton_length", "branch_points", "endpoints", F.when(simple, F.col("skeleton_length") / dist).alias("tortuosity"))


def _distances(inside: np.ndarray, reach: int) -> np.ndarray:
    """Euclidean distance to the nearest background pixel, exact up to ``reach``."""
    h = inside.shape[0]
    up, g = np.full(inside.shape[1], reach + 1), np.empty(inside.shape, dtype=np.int64)
    for y in range(h):
        up = np.where(inside[y], np.minimum(up + 1, reach + 1), 0)
        g[y] = up
    down = np.full(inside.shape[1], reach + 1)
    for y in range(h - 1, -1, -1):
        down = np.where(inside[y], np.minimum(down + 1, reach + 1), 0)
        g[y] = np.minimum(g[y], down)
    best = g * g
    sq = np.pad(g * g, ((0, 0), (reach, reach)), constant_values=(reach + 1) ** 2)
    w = inside.shape[1]
    for d in range(1, reach + 1):
        best = np.minimum(best, np.minimum(sq[:, reach - d:reach - d + w], sq[:, reach + d:reach + d + w]) + d * d)
    return np.sqrt(best)


def _measure(tile: int, halo: int):
    """Distance of each skeleton point of a tile to the background of its window."""
    def work(pdf, pts):
        import pandas as pd

        if len(pts) == 0 or len(pdf) == 0:
            return pts.iloc[:0][["image_id", "region_id"]].assign(d=0.0)
        a, _, oy, ox = _paint(pdf, tile, halo)
        inside = a > 0
        fh, fw = int(pdf["fh"].iloc[0]), int(pdf["fw"].iloc[0])
        inside[:max(0, -oy)], inside[max(0, fh - oy):] = True, True
        inside[:, :max(0, -ox)], inside[:, max(0, fw - ox):] = True, True
        d = _distances(inside, halo)
        return pd.DataFrame({"image_id": pts["image_id"], "region_id": pts["region_id"],
                             "d": d[pts["y"].to_numpy() - oy, pts["x"].to_numpy() - ox]})

    return work


def max_widths(labelled: DataFrame, skel: DataFrame, tile: int = THIN_TILE, halo: int = THIN_HALO) -> DataFrame:
    """Twice the greatest distance to background on each skeleton.

    Outside the frame nothing counts as background.  Regions wider than the halo are
    measured again with a halo twice as large.
    """
    kind = dict(labelled.dtypes)["image_id"]
    runs, points, parts = labelled.select("image_id", "fh", "fw", "region_id", "y", "x0", "x1"), skel, []
    limit = labelled.agg(F.max(F.greatest("fh", "fw"))).first()[0] or 1
    while True:
        work = _measure(tile, halo)
        at = points.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})
        keys = ["image_id", "ty", "tx"]
        got = _tiled_runs(runs, tile, halo).groupBy(*keys).cogroup(at.groupBy(*keys)).applyInPandas(
            work, f"image_id {kind}, region_id bigint, d double")
        best = materialize(got.groupBy(*KEY).agg(F.max("d").alias("d")), "widths")
        parts.append(best.filter(F.col("d") <= halo) if halo < limit else best)
        open_ = best.filter(F.col("d") > halo)
        if halo >= limit or open_.isEmpty():
            break
        runs, points, halo = G.keep_regions(runs, open_), points.join(open_.select(*KEY), KEY, "left_semi"), halo * 2
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(*KEY, (F.col("d") * 2).alias("max_width"))


HULL_BLOCK = 4096  # rows of a region whose corners meet first


def _sides(pdf):
    """Convex chains of both sides of every region in a batch, as rows of their corners in order.

    Coordinates are doubled, so corners are integers; the right side is mirrored (``v`` is minus its column), so both are lower chains.
    """
    import pandas as pd

    keys = pdf[[*KEY, "_blk"] if "_blk" in pdf else KEY]
    first = (keys != keys.shift()).any(axis=1).to_numpy()
    code, side, t, v = np.cumsum(first) - 1, pdf["side"].to_numpy(np.int64), pdf["t"].to_numpy(np.int64), pdf["v"].to_numpy(np.int64)
    order = np.lexsort((v, t, side, code))
    keep, start, now, ts, vs = [], 0, None, [], []
    for i, g, p, q in zip(order.tolist(), (code * 2 + side)[order].tolist(), t[order].tolist(), v[order].tolist()):
        if g != now:
            start, now = len(keep), g
        elif ts[-1] == p:
            continue
        while len(keep) - start > 1 and (ts[-1] - ts[-2]) * (q - vs[-2]) <= (vs[-1] - vs[-2]) * (p - ts[-2]):
            keep.pop(), ts.pop(), vs.pop()
        keep.append(i), ts.append(p), vs.append(q)
    return pdf.iloc[keep].reset_index(drop=True), (code * 2 + side)[keep]


def _edges(pdf):
    """Edges of both chains of every region in a batch."""
    c, chain = _sides(pdf)
    a, b = c.iloc[:-1].reset_index(drop=True), c.iloc[1:].reset_index(drop=True)
    return a.assign(t1=b["t"], v1=b["v"])[chain[:-1] == chain[1:]]


def hull_sides(labelled: DataFrame) -> DataFrame:
    """Where both sides of every region's convex hull cut its rows: (image_id, region_id, side, y, e).

    Pixels reach half a unit each way.  ``e`` is the first column on side 0 and minus the last on side 1.  Many regions share
    a call, since a call costs more than a small hull; a tall region meets first in blocks of rows.
    """
    kind = dict(labelled.dtypes)["image_id"]
    ends = labelled.groupBy(*KEY, "y").agg(F.min("x0").alias("a"), F.max("x1").alias("b"))
    t, left, right = 2 * F.col("y").cast("long"), 2 * F.col("a").cast("long"), -2 * F.col("b").cast("long")
    corner = lambda side, dt, v: F.struct(F.lit(side).alias("side"), (t + dt).alias("t"), v.alias("v"))
    corners = ends.select(*KEY, F.floor(F.col("y") / HULL_BLOCK).alias("_blk"), F.inline(F.array(*[
        corner(side, dt, v if dt else v - 1) for side, v in ((0, left), (1, right)) for dt in (-1, 0, 1)])))
    plain = f"image_id {kind}, region_id bigint, side int, t bigint, v bigint"
    small = by_key_stream(corners, [*KEY, "_blk"], lambda pdf: _sides(pdf)[0].drop(columns="_blk"), plain)
    edges = by_key_stream(small, KEY, _edges, plain + ", t1 bigint, v1 bigint")
    rows = edges.withColumn("y", F.explode(F.expr("filter(sequence((t + pmod(t, 2)) div 2, t1 div 2), s -> 2 * s < t1)")))
    at = F.col("v") + (2 * F.col("y") - F.col("t")) * (F.col("v1") - F.col("v")) / (F.col("t1") - F.col("t"))
    return rows.select(*KEY, "side", F.col("y").cast("int").alias("y"), F.ceil(at / 2 - 1e-10).cast("int").alias("e"))


def hull_runs(labelled: DataFrame) -> DataFrame:
    """Rows of each region's convex hull ``(image_id, region_id, y, x0, x1)``; pixels reach half a unit each way."""
    return hull_sides(labelled).groupBy(*KEY, "y").agg(F.max(F.when(F.col("side") == 0, F.col("e"))).alias("x0"), F.max(F.when(F.col("side") == 1, -F.col("e"))).alias("x1"))


def hull_areas(labelled: DataFrame) -> DataFrame:
    """Hull area per region, summed over its two sides."""
    return hull_sides(labelled).groupBy(*KEY).agg((F.count_if(F.col("side") == 0) - F.sum("e")).alias("hull_area"))


def hull_border(hull: DataFrame) -> DataFrame:
    """Pixels of a hull with a 4-neighbour outside it.  A hull has one run a row, so its rows above and below tell them."""
    near = hull.select(*KEY, "y", "x0", "x1", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_d"))
    own = lambda c: F.max(F.when(F.col("_d") == 0, F.col(c)))
    rows = near.groupBy(*KEY, (F.col("y") + F.col("_d")).alias("y")).agg(
        own("x0").alias("a"), own("x1").alias("b"), F.max("x0").alias("_lo"), F.min("x1").alias("_hi"), F.count(F.lit(1)).alias("_n")).filter("a IS NOT NULL")
    rows = rows.withColumns({"_lo": F.greatest("_lo", F.col("a") + 1), "_hi": F.least("_hi", F.col("b") - 1)})
    inner = (F.col("_n") == 3) & (F.col("_lo") <= F.col("_hi"))
    edge = F.when(inner, F.concat(F.sequence("a", F.col("_lo") - 1), F.sequence(F.col("_hi") + 1, "b"))).otherwise(F.sequence("a", "b"))
    return rows.select(*KEY, "y", F.explode(edge).alias("x"))


def hull_measures(labelled: DataFrame) -> DataFrame:
    """Hull area and hull perimeter per region."""
    hull = materialize(hull_runs(labelled), "hulls")
    area = hull.groupBy(*KEY).agg(F.sum(G.run_length()).alias("hull_area"))
    return area.join(G.border_lengths(hull_border(hull)).withColumnRenamed("length", "hull_perimeter"), KEY)


def shape_measurements(labelled: DataFrame, **tiling) -> DataFrame:
    """The measurement row of every region: size, skeleton, widths, tortuosity, axes and roughness."""
    labelled = materialize(labelled, "regions")
    skel = skeleton(labelled, **tiling)
    props, stats = G.region_props(labelled), skeleton_stats(skel)
    per, hull = G.perimeters(labelled).drop("area"), hull_measures(labelled)
    j = props.join(stats, KEY, "left").join(max_widths(labelled, skel, **tiling), KEY, "left").join(per, KEY).join(hull, KEY)
    root = F.sqrt("area")
    perim = F.when(F.col("perimeter") > 0, F.col("perimeter")).otherwise(1.0)
    return j.select(
        *KEY, "area", F.round(100.0 * F.col("area") / (F.col("fh") * F.col("fw")), 4).alias("area_pct"),
        F.coalesce("skeleton_length", F.lit(0)).alias("skeleton_length"),
        F.round(F.coalesce(F.col("area") / F.col("skeleton_length"), root), 2).alias("mean_width"),
        F.round(F.coalesce("max_width", root), 2).alias("max_width"), F.round("tortuosity", 3).alias("tortuosity"),
        F.coalesce("branch_points", F.lit(0)).alias("branch_points"), F.round("major", 2).alias("major"), F.round("minor", 2).alias("minor"),
        F.round(F.degrees("orientation"), 2).alias("orientation_deg"),
        F.round(perim / F.greatest(F.col("hull_perimeter"), F.lit(1.0)), 3).alias("roughness"),
        F.round("cx", 1).alias("cx"), F.round("cy", 1).alias("cy"), F.round(F.col("area") / F.col("hull_area"), 4).alias("solidity"))


def curvilinear(labelled: DataFrame, min_area: int = 150, min_skeleton: int = 45, min_elongation: float = 2.6, **tiling) -> DataFrame:
    """Regions that look like a path: a long skeleton or clearly elongated."""
    labelled = materialize(labelled, "regions")
    p = G.region_props(labelled).filter(F.col("area") >= min_area)
    s = skeleton_stats(skeleton(G.keep_regions(labelled, p), **tiling))
    long_ = F.coalesce(F.col("skeleton_length"), F.lit(0)) >= min_skeleton
    thin_ = F.col("major") / F.greatest(F.col("minor"), F.lit(1e-6)) >= min_elongation
    return G.keep_regions(labelled, p.join(s, KEY, "left").filter(long_ | thin_))
