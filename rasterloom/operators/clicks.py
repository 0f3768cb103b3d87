"""What a click means: the predicted region, else the weak region, else a flood of similar values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import regions as G
from rasterloom.operators import runs as R
from rasterloom.operators.components import local_labels, label_runs
from rasterloom.session import materialize
from rasterloom.sources.tables import PACK


ENTRY = ["click_id", "image_id", "seed", "tol", "fh", "fw", "kind", "y", "x0", "x1"]
FLOOD_TILE = 512
ENTRIES = 4096  # stretches of one tile that a call takes, on average


def _entered(tile_of, entries, tile: int, reach: int):
    """What the clicks of one tile fill there: runs, where they leave the tile, and one pixel of each piece filled.

    ``entries`` hold, per click, the stretches by which it enters (kind 0) and a pixel of each piece that it
    filled before (kind 1).
    """
    import numpy as np
    import pandas as pd

    img = np.full((tile, tile), np.nan)
    img.reshape(-1)[np.asarray(tile_of["cells"].iloc[0], np.int64)] = np.asarray(tile_of["values"].iloc[0], float)
    y_at, x_at = int(tile_of["ty"].iloc[0]) * tile, int(tile_of["tx"].iloc[0]) * tile
    code, clicks = pd.factorize(entries["click_id"])
    first = entries.iloc[np.unique(code, return_index=True)[1]].reset_index(drop=True)
    parts = []
    for c, (seed, tol) in enumerate(zip(first["seed"], first["tol"])):
        mask = np.zeros((tile, tile + 2), np.int8)
        mask[:, 1:-1] = np.abs(img - seed) <= tol
        turn = np.diff(mask, axis=1)
        (y, x0), x1 = np.nonzero(turn == 1), np.nonzero(turn == -1)[1] - 1
        parts.append((np.full(len(y), c), y, x0, x1))
    of, y, x0, x1 = (np.concatenate(p).astype(np.int64) for p in zip(*parts))
    label = local_labels(of, y, x0, x1, reach)
    piece = (of * tile + label // PACK) * tile + label % PACK
    row = of * tile + y
    starts, ends = row * tile + x0, row * tile + x1  # in order, since runs come row by row

    def pieces_at(part):
        at = (code[part] * tile + (entries["y"].to_numpy()[part] - y_at)) * tile - x_at
        lo = np.searchsorted(ends, at + entries["x0"].to_numpy()[part], side="left")
        hi = np.searchsorted(starts, at + entries["x1"].to_numpy()[part], side="right")
        n = np.maximum(hi - lo, 0)
        return np.unique(piece[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])

    known = entries["kind"].to_numpy() == 1
    new = np.setdiff1d(pieces_at(~known), pieces_at(known))
    got = np.isin(piece, new)
    of, y, x0, x1 = of[got], y[got], x0[got], x1[got]
    rows = [(of, np.full(len(of), 2), y + y_at, x0 + x_at, x1 + x_at),
            (new // (tile * tile), np.full(len(new), 1), new // tile % tile + y_at, new % tile + x_at, new % tile + x_at)]
    for edge, step in ((0, -1), (tile - 1, 1)):
        at = y == edge
        rows.append((of[at], np.zeros(at.sum(), int), y[at] + y_at + step, x0[at] + x_at - reach, x1[at] + x_at + reach))
        side = (x0 if edge == 0 else x1) == edge
        for dy in range(-reach, reach + 1):
            x = np.full(side.sum(), edge + step + x_at)
            rows.append((of[side], np.zeros(side.sum(), int), y[side] + y_at + dy, x, x))
    of, kind, y, x0, x1 = (np.concatenate(c) for c in zip(*rows))
    out = first.iloc[of].reset_index(drop=True)
    return out.assign(kind=kind, y=y, x0=x0, x1=x1)[ENTRY]


def flood(seeds: DataFrame, px: DataFrame, tolerance: DataFrame, value: str = "v", connectivity: int = 8, tile: int = FLOOD_TILE) -> DataFrame:
    """Runs of the connected set around each seed whose values stay within the frame's tolerance of the seed's.

    ``seeds`` are (click_id, image_id, y, x); the runs carry the click as ``image_id``.  A flood goes out from its seed
    tile by tile: a round meets only the tiles that were entered in the round before, so a click reads what it
    fills and not its frame.  A tile is loaded once for all clicks that enter it; the clicks of a tile in
    great demand are dealt over several calls.
    """
    reach = 1 if connectivity == 8 else 0
    place = {"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")}
    at = seeds.join(px.select("image_id", "y", "x", "fh", "fw", F.col(value).cast("double").alias("seed")), ["image_id", "y", "x"]).join(tolerance, "image_id")
    found = materialize(at.select("click_id", "image_id", "seed", F.col("tol").cast("double").alias("tol"), "fh", "fw", F.lit(0).alias("kind"), "y", F.col("x").alias("x0"), F.col("x").alias("x1")), "seeds")
    asked = px.join(found.select("image_id").distinct(), "image_id", "left_semi").withColumns(place)
    cell = ((F.col("y") % tile) * tile + F.col("x") % tile).cast("int")
    tiles = asked.groupBy("image_id", "ty", "tx").agg(F.collect_list(F.struct(cell.alias("cell"), F.col(value).cast("double").alias("v"))).alias("_c"))
    tiles = materialize(tiles.select("image_id", "ty", "tx", F.col("_c.cell").alias("cells"), F.col("_c.v").alias("values")), "tiles")
    kinds = {c: found.schema[c].dataType.simpleString() for c in ENTRY}
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items())
    keys = ["image_id", "ty", "tx"]
    filled, seen, work = None, found.filter("false"), found
    while True:
        inside = work.filter("kind = 0 AND y >= 0 AND y < fh AND x1 >= 0 AND x0 < fw")
        cols = F.explode(F.sequence(F.floor(F.greatest("x0", F.lit(0)) / tile).cast("int"), F.floor(F.least("x1", F.col("fw") - 1) / tile).cast("int")))
        front = inside.withColumn("ty", place["ty"]).withColumn("tx", cols).withColumns({"x0": F.greatest("x0", F.col("tx") * tile), "x1": F.least("x1", F.col("tx") * tile + tile - 1)}).distinct()
        front = materialize(front, "front")
        if front.isEmpty():
            break
        before = seen.withColumn("ty", place["ty"]).withColumn("tx", F.floor(F.col("x0") / tile).cast("int"))
        work = front.unionByName(before.join(front.select("click_id", "ty", "tx").distinct(), ["click_id", "ty", "tx"], "left_semi").select(*front.columns))
        calls = front.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ENTRIES).cast("int").alias("calls"))
        dealt = work.join(calls, keys).withColumn("call", F.pmod(F.xxhash64("click_id"), F.col("calls")).cast("int"))
        copies = tiles.join(calls.withColumnRenamed("calls", "times"), keys).withColumn("call", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))

        def fill(entries, tile_of):
            if not len(entries) or not len(tile_of):
                return entries.iloc[:0][ENTRY]
            return _entered(tile_of, entries, tile, reach)

        group = [*keys, "call"]
        work = materialize(dealt.groupBy(*group).cogroup(copies.groupBy(*group)).applyInPandas(fill, schema), "flood")
        seen = materialize(seen.unionByName(work.filter("kind = 1")), "seen")
        runs = work.filter("kind = 2")
        filled = runs if filled is None else filled.unionByName(runs)
    if filled is None:
        filled = found.filter("false")
    # pieces of one run in neighbouring tiles become one
    return R.union(filled.select(F.col("click_id").alias("image_id"), "fh", "fw", "y", "x0", "x1"))


def frame_tolerance(px: DataFrame, value: str = "v", floor: float = 0.02, share: float = 0.75) -> DataFrame:
    return px.groupBy("image_id").agg(F.greatest(F.lit(floor), F.stddev_pop(value) * share).alias("tol"))


def region_under(clicks: DataFrame, labelled: DataFrame) -> DataFrame:
    """Region of a labelled mask under each click; clicks on background are absent."""
    hit = clicks.join(labelled.select("image_id", "y", "x0", "x1", "region_id"), ["image_id", "y"]).filter("x BETWEEN x0 AND x1")
    return hit.select("click_id", "image_id", "region_id").join(G.areas(labelled), G.KEY).select("click_id", "region_id", "area")


def resolve_clicks(clicks: DataFrame, px: DataFrame, predicted: DataFrame, weak: DataFrame, labels: DataFrame, value: str = "v",
                   max_fraction: float = 0.25, **opts) -> DataFrame:
    """Source, size and new label state of every click.

    ``clicks`` carry (click_id, image_id, y, x, mode); ``px`` the displayed values with the
    frame size.  Confirm writes 1, remove writes 2, toggle flips a pixel already marked 2.
    """
    a = region_under(clicks, label_runs(predicted, 8, **opts)).select("click_id", F.col("area").alias("a"))
    b = region_under(clicks, label_runs(weak, 8, **opts)).select("click_id", F.col("area").alias("b"))
    j = clicks.join(a, "click_id", "left").join(b, "click_id", "left")
    open_ = j.filter("a IS NULL AND b IS NULL").select("click_id", "image_id", "y", "x")
    filled = flood(open_, px, frame_tolerance(px, value), value, **opts).groupBy(F.col("image_id").alias("click_id")).agg(
        F.sum(G.run_length()).alias("c"), F.first(F.col("fh") * F.col("fw")).alias("_n"))
    j = j.join(filled, "click_id", "left").join(labels.select("image_id", "y", "x", "state"), ["image_id", "y", "x"], "left")
    source = F.when(F.col("a").isNotNull(), "predicted region").when(F.col("b").isNotNull(), "weak region").when(F.col("c").isNotNull(), "similar values")
    refused = (source == "similar values") & (F.col("c") > max_fraction * F.col("_n"))
    was_negative = F.coalesce(F.col("state") == 2, F.lit(False))
    state = F.when(F.col("mode") == "confirm", 1).when(F.col("mode") == "remove", 2).when(was_negative, 1).otherwise(2)
    found = source.isNotNull() & ~F.coalesce(refused, F.lit(False))
    return j.select("click_id", "image_id", "y", "x", "mode", source.alias("source"), F.coalesce("a", "b", "c").alias("region_px"),
                    F.coalesce(refused, F.lit(False)).alias("refused"), F.when(found, state).alias("new_state"))
