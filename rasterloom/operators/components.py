"""Connected regions of run masks.

Runs are cut at tile borders and joined up inside each tile (a bounded group); only the
pieces that touch a seam enter the seam graph.  Its edges are merged by a quadtree: first the seams inside
each block of two by two tiles, then those between the blocks of four by four, and so on, so the number of rounds is
the logarithm of a frame's side in tiles, and a group holds the edges on one cross of seams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.runs import RUN
from rasterloom.session import by_key_stream, materialize
from rasterloom.sources.tables import PACK

TILE = 1024


def local_labels(tile_code, y, x0, x1, reach):
    """Smallest packed (y, x) among the runs connected to each run, for the runs of many tiles at once."""
    import numpy as np

    order = np.lexsort((x0, y, tile_code))
    code, ys = tile_code[order].astype(np.int64), y[order].astype(np.int64)
    a, b = x0[order].astype(np.int64), x1[order].astype(np.int64)
    new_row = np.r_[False, (code[1:] != code[:-1]) | (ys[1:] != ys[:-1])]
    skip = np.r_[False, (code[1:] != code[:-1]) | (ys[1:] - ys[:-1] > 1)]
    row = np.cumsum(new_row.astype(np.int64) + skip)  # rows that do not touch are two apart
    starts, ends = row * PACK + a, row * PACK + b
    first = np.searchsorted(ends, starts + PACK - reach, side="left")
    last = np.searchsorted(starts, ends + PACK + reach, side="right")
    n = np.maximum(last - first, 0)
    src = np.repeat(np.arange(len(ys)), n)
    dst = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    label = np.arange(len(ys))
    while True:
        low = np.minimum(label[src], label[dst])
        new = label.copy()
        np.minimum.at(new, label[src], low)
        np.minimum.at(new, label[dst], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    out = np.empty(len(ys), dtype=np.int64)
    out[order] = (ys * PACK + a)[label]
    return out


def _cut(runs: DataFrame, tile: int) -> DataFrame:
    col = F.explode(F.sequence(F.floor(F.col("x0") / tile).cast("int"), F.floor(F.col("x1") / tile).cast("int")))
    cut = runs.select(*RUN, F.col("x0").alias("rx0"), col.alias("tx"))
    return cut.withColumns({
        "x0": F.greatest("x0", F.col("tx") * tile), "x1": F.least("x1", F.col("tx") * tile + tile - 1),
        "ty": F.floor(F.col("y") / tile).cast("int")})


def _seam_edges(pieces: DataFrame, reach: int, tile: int) -> DataFrame:
    """(image_id, u, v, ty, tx, uy, ux): pieces that touch across a seam, with the tiles of both."""
    p = pieces.select("image_id", "y", "x0", "x1", "ty", "tx", "lid")
    wide = F.sequence(F.floor((F.col("x0") - reach) / tile).cast("int"), F.floor((F.col("x1") + reach) / tile).cast("int"))
    here = [F.col("lid").alias("u"), F.col("ty").alias("uy"), F.col("tx").alias("ux")]
    above = p.filter(F.col("y") % tile == tile - 1).select(
        "image_id", (F.col("y") + 1).alias("y"), F.explode(wide).alias("tx"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), *here)
    below = p.filter(F.col("y") % tile == 0).withColumnRenamed("lid", "v")
    down = above.join(below, ["image_id", "y", "tx"]).filter(
        (F.col("x0") <= F.col("a1") + reach) & (F.col("x1") >= F.col("a0") - reach))
    left = p.filter(F.col("x1") % tile == tile - 1).select(
        "image_id", F.explode(F.sequence(F.col("y") - reach, F.col("y") + reach)).alias("y"), (F.col("x1") + 1).alias("x0"), *here)
    right = p.filter(F.col("x0") % tile == 0).select("image_id", "y", "x0", "ty", "tx", F.col("lid").alias("v"))
    across = left.join(right, ["image_id", "y", "x0"])
    cols = ["image_id", "u", "v", "ty", "tx", "uy", "ux"]
    return down.select(*cols).union(across.select(*cols)).filter("u <> v").distinct()


def forest(u, v):
    """(nodes, roots) of the components of the edges (u, v), the roots themselves left out."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def quadtree_roots(edges: DataFrame) -> DataFrame:
    """(image_id, node, root) of every piece of the seam graph but the roots, merged level by level.

    An edge is settled at the level of the smallest block that holds both its tiles.  What a block has merged is
    renamed in the edges of the levels above, so a call sees one block's own seams only.
    """
    level = F.ceil(F.log2(F.greatest(F.col("ty").bitwiseXOR(F.col("uy")), F.col("tx").bitwiseXOR(F.col("ux"))) + 1.0)).cast("int")
    edges = materialize(edges.withColumn("level", level).select("image_id", "u", "v", "ty", "tx", "level"), "seams")
    kind = dict(edges.dtypes)["image_id"]

    def merge(pdf):
        import pandas as pd

        parts = []
        for image, g in pdf.groupby("image_id", sort=False):  # blocks of one frame share no node, so they merge at once
            nodes, roots = forest(g["u"].to_numpy(), g["v"].to_numpy())
            parts.append(pd.DataFrame({"image_id": image, "node": nodes, "root": roots}))
        return pd.concat(parts)

    known = None
    for k in sorted(r[0] for r in edges.select("level").distinct().collect()):  # at most the logarithm of a frame's side
        now = edges.filter(F.col("level") == k).select("image_id", F.expr(f"shiftright(ty, {k})").alias("by"), F.expr(f"shiftright(tx, {k})").alias("bx"), "u", "v")
        if known is not None:
            for end in ("u", "v"):
                name = known.select("image_id", F.col("node").alias(end), F.col("root").alias("_r"))
                now = now.join(name, ["image_id", end], "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
            now = now.filter("u <> v")
        new = by_key_stream(now, ["image_id", "by", "bx"], merge, f"image_id {kind}, node bigint, root bigint")
        if known is not None:
            new = materialize(new, "merged")
            up = new.select("image_id", F.col("node").alias("root"), F.col("root").alias("_r"))
            moved = known.join(up, ["image_id", "root"], "left").select("image_id", "node", F.coalesce("_r", "root").alias("root"))
            new = moved.unionByName(new)
        known = materialize(new, "merged")
    return edges.select("image_id", F.col("u").alias("node"), F.col("v").alias("root")) if known is None else known


def star_contraction(edges: DataFrame) -> DataFrame:
    """Components of ``(image_id, u, v)`` by alternating large-star and small-star rounds.

    Returns ``(image_id, node, root)`` of every node but the roots, the smallest node of each component.  Every round is a
    grouped minimum and an equi-join, so a hub node is split like any skewed key.
    """
    cur = materialize(edges.select("image_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    if cur.isEmpty():
        return cur.select("image_id", F.col("u").alias("node"), F.col("v").alias("root"))
    signature = None
    while True:
        both = cur.union(cur.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("image_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, ["image_id", "u"]).filter("v > u").select("image_id", F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        small_low = large.groupBy("image_id", "u").agg(F.min("v").alias("m"))
        small = large.join(small_low, ["image_id", "u"])
        nxt = small.select("image_id", F.col("v").alias("u"), F.col("m").alias("v")).union(
            small_low.select("image_id", "u", F.col("m").alias("v"))).filter("u <> v").distinct()
        cur = materialize(nxt, "star")
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("image_id", "u", "v").cast("decimal(38,0)"))).first()
        if now == signature:
            return cur.select("image_id", F.col("u").alias("node"), F.col("v").alias("root"))
        signature = now


def label_runs(runs: DataFrame, connectivity: int, tile: int = TILE) -> DataFrame:
    """Runs with ``region_id``, the packed position of the region's first pixel in scan order.

    ``connectivity`` is 4 or 8 and has no default: counting and pruning differ in it.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    reach = 1 if connectivity == 8 else 0
    cut = _cut(runs, tile)
    kind = dict(runs.dtypes)["image_id"]
    schema = f"image_id {kind}, fh int, fw int, y int, x0 int, x1 int, rx0 int, tx int, ty int, lid bigint"

    def local(pdf):
        code = pdf.groupby(["image_id", "ty", "tx"], sort=False).ngroup().to_numpy()
        return pdf.assign(lid=local_labels(code, pdf["y"].to_numpy(), pdf["x0"].to_numpy(), pdf["x1"].to_numpy(), reach))

    cols = ["image_id", "fh", "fw", "y", "x0", "x1", "rx0", "tx", "ty"]
    pieces = materialize(by_key_stream(cut.select(*cols), ["image_id", "ty", "tx"], local, schema), "pieces")
    roots = quadtree_roots(_seam_edges(pieces, reach, tile)).withColumnRenamed("node", "lid")
    named = pieces.join(roots, ["image_id", "lid"], "left")
    named = named.withColumn("region_id", F.coalesce("root", "lid"))
    # A region's first pixel is the smallest root, and pieces of one run share a region.
    whole = named.groupBy("image_id", "fh", "fw", "y", "rx0").agg(F.max("x1").alias("x1"), F.min("region_id").alias("region_id"))
    return whole.select("image_id", "fh", "fw", "y", F.col("rx0").alias("x0"), "x1", "region_id")
