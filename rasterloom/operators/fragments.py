"""Joining large fragments of one crack: near pairs, dark routes between them, spanning tree and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.components import star_contraction
from rasterloom.session import by_key_stream, materialize


NEAR_TILE = 512
STRIP = 1 << 22  # cells of the arrays that are worked on at once


def _tile_pairs(rid, y, x0, x1, y_at: int, x_at: int, tile: int, gap: int):
    """(u, v, d2, ay, ax, by, bx) of one tile: nearest pixels of every two regions, the later one's inside the tile.

    For each region a column pass finds the nearest of its pixels above and below every cell; a row pass then looks ``gap`` columns
    to either side of each border pixel of the later regions.  Work follows border pixels times gap.
    """
    import numpy as np

    size = tile + 2 * gap
    names, of = np.unique(rid, return_inverse=True)
    lo, hi = np.maximum(x0 - x_at, 0), np.minimum(x1 - x_at, size - 1)
    n = hi - lo + 1
    row = y - y_at
    flat = np.repeat(row * size + lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    label = np.full((size + 2, size + 2), -1, np.int32)
    inner = label[1:-1, 1:-1]
    inner[flat // size, flat % size] = np.repeat(of, n)
    edge = (inner >= 0) & ((inner != label[:-2, 1:-1]) | (inner != label[2:, 1:-1]) | (inner != label[1:-1, :-2]) | (inner != label[1:-1, 2:]))
    ey, ex = np.nonzero(edge)
    who = inner[ey, ex]
    box = np.full((len(names), 4), size)
    box[:, [1, 3]] = -1
    for col, v in ((0, row), (2, lo)):
        np.minimum.at(box[:, col], of, v)
    for col, v in ((1, row), (3, hi)):
        np.maximum.at(box[:, col], of, v)
    core = (ey >= gap) & (ey < gap + tile) & (ex >= gap) & (ex < gap + tile)
    by, bx, bw = ey[core], ex[core], who[core]  # in scan order
    reach, far, found = np.arange(-gap, gap + 1), 4 * size, []
    for u in range(len(names) - 1):
        r0, r1, c0, c1 = max(box[u, 0] - gap, 0), min(box[u, 1] + gap, size - 1), max(box[u, 2] - gap, 0), min(box[u, 3] + gap, size - 1)
        first, last = np.searchsorted(by, [r0, r1 + 1])
        ok = (bw[first:last] > u) & (bx[first:last] >= c0) & (bx[first:last] <= c1)
        if not ok.any():
            continue
        py, px, pw = by[first:last][ok], bx[first:last][ok], bw[first:last][ok]
        mine = inner[r0:r1 + 1, c0:c1 + 1] == u
        rows = np.arange(r0, r1 + 1)[:, None]
        up = np.maximum.accumulate(np.where(mine, rows, -far), axis=0)
        down = np.minimum.accumulate(np.where(mine, rows, far)[::-1], axis=0)[::-1]
        best = np.empty(len(py), np.int64)
        step = max(1, STRIP // len(reach))
        for s in range(0, len(py), step):
            yy, xx = py[s:s + step, None], px[s:s + step, None] + reach
            inside = (xx >= c0) & (xx <= c1)
            at = np.clip(xx, c0, c1) - c0
            above, below = up[yy - r0, at], down[yy - r0, at]
            ay = np.where(yy - above <= below - yy, above, below)
            d2 = (yy - ay).astype(np.int64) ** 2 + reach ** 2
            d2[~inside | (d2 > gap * gap)] = 1 << 40
            best[s:s + step] = np.where(d2 < 1 << 40, (d2 * size + ay) * size + xx, 1 << 62).min(1)
        order = np.lexsort((px, py, best, pw))
        order = order[np.r_[True, pw[order][1:] != pw[order][:-1]] & (best[order] < 1 << 62)]
        key = best[order]
        found.append((np.full(len(order), names[u]), names[pw[order]], key // (size * size), key // size % size + y_at, key % size + x_at, py[order] + y_at, px[order] + x_at))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 7


def near_pairs(labelled: DataFrame, max_gap: float, tile: int = NEAR_TILE) -> DataFrame:
    """Nearest pixel pair of every two regions at most ``max_gap`` apart.

    Runs go to the tiles that they reach within the gap; a tile gives one row per pair of regions (``_tile_pairs``).  Ties
    go to the first pixels in scan order.
    """
    gap = int(max_gap)
    tile = max(tile, 2 * gap)
    tiles = lambda lo, hi: F.explode(F.sequence(F.greatest(F.floor((F.col(lo) - gap) / tile), F.lit(0)).cast("int"), F.floor((F.col(hi) + gap) / tile).cast("int")))
    sent = labelled.select("image_id", "region_id", "y", "x0", "x1", tiles("y", "y").alias("ty")).withColumn("tx", tiles("x0", "x1"))
    kind = dict(labelled.dtypes)["image_id"]

    def meet(pdf):
        import numpy as np
        import pandas as pd

        out = []
        for (image, ty, tx), g in pdf.groupby(["image_id", "ty", "tx"], sort=False):
            cols = (g[c].to_numpy(np.int64) for c in ("region_id", "y", "x0", "x1"))
            got = _tile_pairs(*cols, ty * tile - gap, tx * tile - gap, tile, gap)
            out.append(pd.DataFrame(dict(zip(("u", "v", "d2", "ay", "ax", "by", "bx"), got))).assign(image_id=image))
        return pd.concat(out)[["image_id", "u", "v", "d2", "ay", "ax", "by", "bx"]]

    met = by_key_stream(sent, ["image_id", "ty", "tx"], meet, f"image_id {kind}, u bigint, v bigint, d2 bigint, ay int, ax int, by int, bx int")
    best = met.filter(F.col("d2") <= max_gap * max_gap).groupBy("image_id", "u", "v").agg(F.min(F.struct("d2", "ay", "ax", "by", "bx")).alias("_m"))
    return best.select("image_id", "u", "v", F.sqrt("_m.d2").alias("gap"), "_m.ay", "_m.ax", "_m.by", "_m.bx")


FLAT = 1e-6  # added to a step's cost by its length, so that routes over zero cost still have a direction
SIDES = [(dy, dx, (2 ** 0.5 if dy and dx else 1.0)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def distances(cost, starts):
    """Cheapest 8-connected distance from each array's start, for a stack (n, h, w) of cost arrays at once.

    A step costs the mean of its ends times its length.  Sweeps go down and up: a row takes what its neighbour row offers, then
    spreads it sideways by running minima over prefix sums, until nothing improves.  Infinite cost is outside.
    """
    import numpy as np

    n, h, w = cost.shape
    c = np.where(np.isfinite(cost), cost + FLAT, 1e12)
    d = np.full((n, h, w), np.inf)
    d[np.arange(n), starts[:, 0], starts[:, 1]] = 0
    run = np.concatenate([np.zeros((n, h, 1)), np.cumsum((c[:, :, 1:] + c[:, :, :-1]) / 2, axis=2)], axis=2)
    while True:
        before = d.copy()
        for rows in (range(h), range(h - 1, -1, -1)):
            last = None
            for y in rows:
                here = d[:, y]
                if last is not None:
                    from_row, step = d[:, last], c[:, last]
                    here = np.minimum(here, from_row + (step + c[:, y]) / 2)
                    here[:, 1:] = np.minimum(here[:, 1:], from_row[:, :-1] + (step[:, :-1] + c[:, y, 1:]) * (2 ** 0.5 / 2))
                    here[:, :-1] = np.minimum(here[:, :-1], from_row[:, 1:] + (step[:, 1:] + c[:, y, :-1]) * (2 ** 0.5 / 2))
                s = run[:, y]
                right = s + np.minimum.accumulate(here - s, axis=1)
                left = np.minimum.accumulate((here + s)[:, ::-1], axis=1)[:, ::-1] - s
                d[:, y] = np.minimum(here, np.minimum(right, left))
                last = y
        with np.errstate(invalid="ignore"):
            if not (before - d > 1e-9 * (1 + d)).any():
                return d


def routes(cost, starts, ends):
    """Cells of the cheapest route of every array, as (row, column) lists from the end back to the start."""
    import numpy as np

    n, h, w = cost.shape
    d = np.pad(distances(cost, starts), ((0, 0), (1, 1), (1, 1)), constant_values=np.inf)
    c = np.pad(np.where(np.isfinite(cost), cost + FLAT, 1e12), ((0, 0), (1, 1), (1, 1)), constant_values=1e12)
    at, which = ends + 1, np.arange(n)
    goal, path = starts + 1, [[tuple(e)] for e in ends.tolist()]
    while len(which):
        y, x = at[which, 0], at[which, 1]
        offers = np.stack([d[which, y + dy, x + dx] + (c[which, y, x] + c[which, y + dy, x + dx]) / 2 * length for dy, dx, length in SIDES])
        lower = np.stack([d[which, y + dy, x + dx] for dy, dx, _ in SIDES]) < d[which, y, x]  # each step comes nearer to the start
        pick = np.where(lower, offers, np.inf).argmin(0)
        at[which] += np.array([s[:2] for s in SIDES])[pick]
        for i in which.tolist():
            path[i].append((int(at[i, 0]) - 1, int(at[i, 1]) - 1))
        which = which[(at[which] != goal[which]).any(1)]
    return path


def route_brightness(pairs: DataFrame, px: DataFrame, value: str = "v", margin: int = 15, percentile: float = 75.0, fill: float = 0.0, max_gap: float = 80,
                     tile: int = NEAR_TILE) -> DataFrame:
    """Pairs with ``bridge``, a high percentile of brightness along the darkest route between their nearest pixels.

    A route stays in the pair's bounding box plus ``margin``, which ``max_gap`` bounds.  Pixels go to the tiles whose pairs
    may need them, and all pairs of a tile are solved on arrays together.
    """
    reach = int(max_gap) + 2 * margin + 1
    box = pairs.withColumns({
        "r0": F.greatest(F.least("ay", "by") - margin, F.lit(0)), "r1": F.greatest("ay", "by") + margin,
        "c0": F.greatest(F.least("ax", "bx") - margin, F.lit(0)), "c1": F.greatest("ax", "bx") + margin})
    box = box.withColumns({"ty": F.floor(F.col("r0") / tile).cast("int"), "tx": F.floor(F.col("c0") / tile).cast("int")})
    keys = ["image_id", "ty", "tx"]
    back = lambda c: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - reach) / tile), F.lit(0)).cast("int"), F.floor(F.col(c) / tile).cast("int")))
    p = px.select("image_id", "fh", "fw", "y", "x", F.col(value).cast("double").alias("pv"), back("y").alias("ty")).withColumn("tx", back("x"))
    p = p.join(box.select(*keys).distinct(), keys, "left_semi")
    kind = dict(pairs.dtypes)["image_id"]

    def walk(some, pdf):
        import numpy as np
        import pandas as pd

        if len(some) == 0:
            return pd.DataFrame({"image_id": [], "u": [], "v": [], "bridge": []})
        y_at, x_at, side = int(some["ty"].iloc[0]) * tile, int(some["tx"].iloc[0]) * tile, tile + reach + 1
        fh, fw = (int(pdf["fh"].iloc[0]), int(pdf["fw"].iloc[0])) if len(pdf) else (1 << 30, 1 << 30)
        img = np.full((side, side), fill)
        oy, ox = pdf["y"].to_numpy() - y_at, pdf["x"].to_numpy() - x_at
        held = (oy < side) & (ox < side)
        img[oy[held], ox[held]] = pdf["pv"].to_numpy()[held]
        box_of = np.stack([some["r0"] - y_at, np.minimum(some["r1"], fh - 1) - y_at, some["c0"] - x_at, np.minimum(some["c1"], fw - 1) - x_at], axis=1).astype(int)
        size = box_of[:, [1, 3]] - box_of[:, [0, 2]] + 1
        ends = {c: np.stack([some[c[0] + "y"] - y_at, some[c[0] + "x"] - x_at], axis=1).astype(int) - box_of[:, [0, 2]] for c in ("a", "b")}
        h, w = size.max(0)
        bridge = np.empty(len(some))
        for lo in range(0, len(some), step := max(1, STRIP // (h * w))):
            part = range(lo, min(len(some), lo + step))
            cost = np.full((len(part), h, w), np.inf)
            for k, i in enumerate(part):
                cost[k, :size[i, 0], :size[i, 1]] = img[box_of[i, 0]:box_of[i, 1] + 1, box_of[i, 2]:box_of[i, 3] + 1]
            for k, path in enumerate(routes(cost, ends["a"][lo:lo + step], ends["b"][lo:lo + step].copy())):
                bridge[lo + k] = np.percentile([cost[k, y, x] for y, x in path], percentile)
        return some[["image_id", "u", "v"]].assign(bridge=bridge)

    got = box.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(walk, f"image_id {kind}, u bigint, v bigint, bridge double")
    return pairs.join(got, ["image_id", "u", "v"])


def spanning_tree(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest of ``(image_id, u, v, gap)``: every round each group takes its shortest outgoing edge."""
    left = materialize(edges.withColumns({"gu": F.col("u"), "gv": F.col("v")}), "mst")
    tree = None
    while not left.isEmpty():
        offers = left.select("image_id", F.explode(F.array("gu", "gv")).alias("g"), F.struct("gap", "u", "v").alias("e"))
        picked = offers.groupBy("image_id", "g").agg(F.min("e").alias("e")).select("image_id", "e.u", "e.v", "e.gap").distinct()
        tree = materialize(picked if tree is None else tree.unionByName(picked).distinct(), "mst")
        root = star_contraction(tree.select("image_id", "u", "v"))
        ru, rv = root.toDF("image_id", "u", "gu"), root.toDF("image_id", "v", "gv")
        nxt = left.select("image_id", "u", "v", "gap").join(ru, ["image_id", "u"], "left").join(rv, ["image_id", "v"], "left")
        nxt = nxt.withColumns({"gu": F.coalesce("gu", "u"), "gv": F.coalesce("gv", "v")}).filter("gu <> gv")
        left = materialize(nxt, "mst")
    return tree if tree is not None else edges


def merge_fragments(labelled: DataFrame, px: DataFrame, min_area: int = 1000, max_gap: float = 80, max_bridge: float = 160, value: str = "v",
                    margin: int = 15, fill: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Group of every large region joined to another, its first region included, and the bridges that join them."""
    from rasterloom.operators import regions as G

    large = materialize(G.keep_regions(labelled, G.areas(labelled).filter(F.col("area") >= min_area)), "large")
    pairs = materialize(near_pairs(large, max_gap), "pairs")
    ok = materialize(route_brightness(pairs, px, value, margin, fill=fill, max_gap=max_gap).filter(F.col("bridge") <= max_bridge), "bridges")
    bridges = spanning_tree(ok.select("image_id", "u", "v", "gap"))
    stars = star_contraction(ok.select("image_id", "u", "v"))
    roots = stars.select("image_id", F.col("root").alias("node"), "root").distinct()
    groups = stars.unionByName(roots).select("image_id", F.col("node").alias("region_id"), F.col("root").alias("group_id"))
    return groups, bridges
