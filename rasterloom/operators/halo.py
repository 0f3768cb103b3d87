"""Neighbourhood operators over tiles with halo exchange.

Frames are dense tiles ``(image_id, ty, tx, y0, x0, h, w, fh, fw, data)`` on a fixed grid.
Frames held in one tile are filtered where they lie.  For the others every tile sends
each neighbour only the block that neighbour's halo needs, so a shuffle moves arrays, not
pixels, and a task sees at most one tile plus its halo.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import kernels as K
from rasterloom.session import in_parts

GEOMETRY = ["image_id", "ty", "tx", "y0", "x0", "h", "w", "fh", "fw"]

# The feature scales, in the order in which the stack lists them.
SMOOTH_SIGMAS = (2, 4, 8, 16, 32, 64)
GRADIENT_SIGMAS = (1, 2, 4, 8)
LAPLACIAN_SIGMAS = (1, 2, 4, 8)
TEXTURE_SIGMAS = (2, 8)
FEATURE_NAMES = (["intensity"] + [f"smooth_s{s}" for s in SMOOTH_SIGMAS] + [f"gradmag_s{s}" for s in GRADIENT_SIGMAS]
                 + [f"laplacian_s{s}" for s in LAPLACIAN_SIGMAS] + [f"texture_s{s}" for s in TEXTURE_SIGMAS])


def tile_grid(frames: DataFrame, tile: int) -> DataFrame:
    """Tile geometry of every frame ``(image_id, fh, fw)``."""
    t = frames.select("image_id", "fh", "fw", F.explode(F.sequence(F.lit(0), F.floor((F.col("fh") - 1) / tile).cast("int"))).alias("ty"))
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("fw") - 1) / tile).cast("int"))).alias("tx"))
    return t.select("image_id", "ty", "tx", (F.col("ty") * tile).alias("y0"), (F.col("tx") * tile).alias("x0"),
                    F.least(F.lit(tile), F.col("fh") - F.col("ty") * tile).alias("h"),
                    F.least(F.lit(tile), F.col("fw") - F.col("tx") * tile).alias("w"), "fh", "fw")


def tiles_from_pixels(px: DataFrame, frames: DataFrame, tile: int, value: str = "v", fill: float = 0.0) -> DataFrame:
    """Dense tiles from sparse pixels; missing pixels and empty tiles read ``fill``."""
    keyed = px.select("image_id", F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"),
                      F.struct("y", "x", F.col(value).cast("double").alias("v")).alias("p"))
    cells = keyed.groupBy("image_id", "ty", "tx").agg(F.collect_list("p").alias("p"))
    grid = tile_grid(frames, tile).join(cells, ["image_id", "ty", "tx"], "left")
    kind = dict(grid.dtypes)["image_id"]
    schema = f"image_id {kind}, ty int, tx int, y0 int, x0 int, h int, w int, fh int, fw int, data array<double>"
    flat = grid.select(*GEOMETRY, F.transform("p", lambda s: (s["y"] - F.col("y0")) * F.col("w") + s["x"] - F.col("x0")).alias("at"),
                       F.col("p.v").alias("val"))

    def fill_in(batches):
        for pdf in in_parts(batches, lambda p: p["h"] * p["w"]):
            out = []
            for h, w, at, val in zip(pdf["h"], pdf["w"], pdf["at"], pdf["val"]):
                a = np.full(h * w, fill)
                if at is not None:
                    a[np.asarray(at, dtype=np.int64)] = val
                out.append(a)
            yield pdf[GEOMETRY].assign(data=out)

    return flat.mapInPandas(fill_in, schema)


def _bands(win: K.Window, bands: Mapping[str, Callable], extra: dict) -> dict:
    return {n: f(win, **extra) for n, f in bands.items()}


def apply_bands(tiles: DataFrame, halo: int, bands: Mapping[str, Callable], tile: int, extras: Sequence[str] = ()) -> DataFrame:
    """Add one array per band, computed from the tile and ``halo`` pixels around it.

    A band takes a ``Window`` (a stack of equal windows) and, by keyword, the per-frame
    ``extras`` columns; it returns the stack of cores.
    """
    kind = dict(tiles.dtypes)["image_id"]
    names = list(bands)
    geometry = f"image_id {kind}, ty int, tx int, y0 int, x0 int, h int, w int, fh int, fw int, data array<double>"
    out_schema = geometry + "".join(f", {e} double" for e in extras) + "".join(f", {n} array<double>" for n in names)
    cols = GEOMETRY + ["data", *extras]

    # A filter holds the lines around a tile along one axis at a time.
    held = lambda p: (len(names) + 1) * p["h"] * p["w"] + 2 * halo * np.maximum(p["h"], p["w"])

    def whole(batches):
        for pdf in in_parts(batches, held):
            for (h, w), part in pdf.groupby(["h", "w"], sort=False):
                stack = np.stack(part["data"].to_numpy()).reshape(len(part), h, w)
                win = K.Window(stack, (0, 0, h, w), (0, 0), (h, w))
                got = _bands(win, bands, {e: part[e].to_numpy() for e in extras})
                yield part.assign(**{n: list(v.reshape(len(part), -1)) for n, v in got.items()})

    alone = (F.col("fh") <= F.col("h")) & (F.col("fw") <= F.col("w"))
    single = tiles.filter(alone).select(*cols).mapInPandas(whole, out_schema)
    reach = max(1, ceil(halo / tile))

    def send(batches):
        for pdf in in_parts(batches, lambda p: (p["h"] + 2 * halo) * (p["w"] + 2 * halo)):
            rows = []
            for r in pdf.itertuples(index=False):
                a = np.asarray(r.data).reshape(r.h, r.w)
                for ty in range(max(0, r.ty - reach), min((r.fh - 1) // tile, r.ty + reach) + 1):
                    for tx in range(max(0, r.tx - reach), min((r.fw - 1) // tile, r.tx + reach) + 1):
                        y0, y1 = max(r.y0, ty * tile - halo), min(r.y0 + r.h, ty * tile + tile + halo)
                        x0, x1 = max(r.x0, tx * tile - halo), min(r.x0 + r.w, tx * tile + tile + halo)
                        if y0 < y1 and x0 < x1:
                            block = a[y0 - r.y0:y1 - r.y0, x0 - r.x0:x1 - r.x0]
                            rows.append((r.image_id, ty, tx, y0, x0, y1 - y0, x1 - x0, r.fh, r.fw, block.ravel(),
                                         *[getattr(r, e) for e in extras]))
            import pandas as pd

            yield pd.DataFrame(rows, columns=cols)

    block_schema = geometry + "".join(f", {e} double" for e in extras)

    def assemble(pdf):
        import pandas as pd

        f = pdf.iloc[0]
        ty, tx, fh, fw = int(f.ty), int(f.tx), int(f.fh), int(f.fw)
        cy, cx = ty * tile, tx * tile
        h, w = min(tile, fh - cy), min(tile, fw - cx)
        wy, wx = max(0, cy - halo), max(0, cx - halo)
        data = np.zeros((min(fh, cy + h + halo) - wy, min(fw, cx + w + halo) - wx))
        for r in pdf.itertuples(index=False):
            data[r.y0 - wy:r.y0 - wy + r.h, r.x0 - wx:r.x0 - wx + r.w] = np.asarray(r.data).reshape(r.h, r.w)
        win = K.Window(data[None], (cy, cx, h, w), (wy, wx), (fh, fw))
        got = _bands(win, bands, {e: np.array([f[e]]) for e in extras})
        row = {"image_id": f.image_id, "ty": ty, "tx": tx, "y0": cy, "x0": cx, "h": h, "w": w, "fh": fh, "fw": fw,
               "data": win.centre().ravel(), **{e: f[e] for e in extras}, **{n: v.ravel() for n, v in got.items()}}
        return pd.DataFrame([row])

    blocks = tiles.filter(~alone).select(*cols).mapInPandas(send, block_schema)
    multi = blocks.groupBy("image_id", "ty", "tx").applyInPandas(assemble, out_schema)
    return single.unionByName(multi)


def feature_bands() -> dict[str, Callable]:
    """The seventeen per-pixel features, in their fixed order."""
    bands: dict[str, Callable] = {"intensity": lambda w: w.centre()}
    for s in SMOOTH_SIGMAS:
        bands[f"smooth_s{s}"] = lambda w, s=s: K.gaussian(w, s)
    for s in GRADIENT_SIGMAS:
        bands[f"gradmag_s{s}"] = lambda w, s=s: K.gradient_magnitude(w, s)
    for s in LAPLACIAN_SIGMAS:
        bands[f"laplacian_s{s}"] = lambda w, s=s: K.laplacian(w, s)
    for s in TEXTURE_SIGMAS:
        bands[f"texture_s{s}"] = lambda w, s=s: K.local_std(w, s)
    return bands


def feature_stack(tiles: DataFrame, tile: int = 1024) -> DataFrame:
    """All features of every tile in one halo pass."""
    return apply_bands(tiles, int(K.TRUNCATE * max(SMOOTH_SIGMAS) + 0.5), feature_bands(), tile)
