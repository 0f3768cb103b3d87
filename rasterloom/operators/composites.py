"""Composite masks: specimen support, off-specimen, allowed region, crack cores and false-positive zones.

Inputs are dense value tiles; smoothing is a halo band, everything after it runs on runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import kernels as K
from rasterloom.operators import halo as H
from rasterloom.operators import regions as G
from rasterloom.operators import runs as R
from rasterloom.operators.aggregates import otsu
from rasterloom.operators.components import label_runs
from rasterloom.session import materialize


def frames_of(tiles: DataFrame) -> DataFrame:
    return tiles.filter("ty = 0 AND tx = 0").select("image_id", "fh", "fw")


def pixels(tiles: DataFrame, *columns: str) -> DataFrame:
    """Pixel rows with the frame size, for the given array columns."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    rows = tiles.select("image_id", "fh", "fw", "y0", "x0", "w", F.posexplode(zipped).alias("_i", "_z"))
    return rows.select("image_id", "fh", "fw", (F.col("y0") + F.floor(F.col("_i") / F.col("w"))).cast("int").alias("y"),
                       (F.col("x0") + F.col("_i") % F.col("w")).cast("int").alias("x"), *[F.col(f"_z.{c}").alias(c) for c in columns])


def mask_where(tiles: DataFrame, column: str, test: Callable[[Column], Column]) -> DataFrame:
    """Runs of the pixels whose value passes ``test``."""
    return R.from_pixels(pixels(tiles, column).filter(test(F.col(column))))


def smoothed(tiles: DataFrame, sigma: float, tile: int, name: str = "smooth") -> DataFrame:
    return H.apply_bands(tiles, int(K.TRUNCATE * sigma + 0.5), {name: lambda w: K.gaussian(w, sigma)}, tile)


def large_regions(runs: DataFrame, fraction: float, tile: int) -> DataFrame:
    """Regions (8-connected) of at least a fraction of their frame."""
    lab = label_runs(runs, 8, tile=tile)
    size = lab.groupBy(*G.KEY).agg(F.sum(G.run_length()).alias("area"), F.first(F.col("fh") * F.col("fw")).alias("_n"))
    return G.keep_regions(lab, size.filter(F.col("area") >= F.lit(fraction) * F.col("_n"))).select(*R.RUN)


def largest_region(runs: DataFrame, tile: int) -> DataFrame:
    lab = label_runs(runs, 8, tile=tile)
    return G.keep_regions(lab, G.largest(lab)).select(*R.RUN)


def specimen_support(tiles: DataFrame, tile: int, step: int = 4, open_radius: int = 3, close_radius: int = 5,
                     min_fraction: float = 0.005, column: str = "data") -> DataFrame:
    """Runs of the specimen on the coarse grid of every ``step``-th pixel.

    Dark regions that open onto the frame edge and are large are background; the rest is
    specimen, dark cracks included.
    """
    px = pixels(tiles, column).filter((F.col("y") % step == 0) & (F.col("x") % step == 0))
    small = px.select("image_id", F.ceil(F.col("fh") / step).cast("int").alias("fh"), F.ceil(F.col("fw") / step).cast("int").alias("fw"),
                      F.floor(F.col("y") / step).cast("int").alias("y"), F.floor(F.col("x") / step).cast("int").alias("x"), F.col(column).alias("v"))
    dark = small.join(otsu(small, ["image_id"], "v"), "image_id").filter("v < threshold")
    opened = R.opening(R.from_pixels(dark), R.disk(open_radius), outside=True)
    lab = label_runs(opened, 8, tile=tile)
    off = G.keep_regions(lab, G.border_touching(lab, min_fraction)).select(*R.RUN)
    off = R.closing(off, R.disk(close_radius), outside=True)
    frames = frames_of(tiles).select("image_id", F.ceil(F.col("fh") / step).cast("int").alias("fh"), F.ceil(F.col("fw") / step).cast("int").alias("fw"))
    return G.fill_holes(R.complement(off, frames), tile=tile)


def refine(coarse: DataFrame, frames: DataFrame, step: int) -> DataFrame:
    """Coarse runs repeated ``step`` times each way, cropped to the full frame."""
    c = coarse.select("image_id", "y", "x0", "x1").join(frames, "image_id")
    c = c.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(step - 1))))
    c = c.select("image_id", "fh", "fw", (F.col("y") * step + F.col("_k")).alias("y"), (F.col("x0") * step).alias("x0"),
                 F.least((F.col("x1") + 1) * step, F.col("fw")).alias("x1")).withColumn("x1", F.col("x1") - 1)
    return c.filter("y < fh")


def off_specimen(tiles: DataFrame, tile: int, sigma: float = 8.0, dark_max: float = 0.25, min_fraction: float = 0.005, grow: int = 6) -> DataFrame:
    """Large dark regions that meet the frame edge, grown a little."""
    dark = mask_where(smoothed(tiles, sigma, tile), "smooth", lambda v: v < dark_max)
    lab = label_runs(dark, 8, tile=tile)
    return R.dilate(G.keep_regions(lab, G.border_touching(lab, min_fraction, strict=False)).select(*R.RUN), R.box(grow))


def allowed_region(tiles: DataFrame, tile: int, sigma: float = 2.0, bright_min: float = 0.5, close: int = 20, inset: int = 30,
                   border: int = 20, wedge_fraction: float = 0.002) -> DataFrame:
    """Where a crack may lie: inside the specimen envelope, off the frame border and off any large dark feature."""
    smooth = materialize(smoothed(tiles, sigma, tile), "smooth")
    body = largest_region(mask_where(smooth, "smooth", lambda v: v > bright_min), tile)
    envelope = G.fill_holes(R.closing(body, R.box(close)), tile=tile)
    inner = R.border_blank(R.erode(envelope, R.box(inset)), border)
    big = large_regions(mask_where(smooth, "smooth", lambda v: v <= bright_min), wedge_fraction, tile)
    return R.subtract(inner, R.dilate(big, R.box(inset)))


def false_positive_zone(tiles: DataFrame, predicted: DataFrame, tile: int, sigma: float = 3.0, dark_max: float = 0.3,
                        wedge_fraction: float = 0.002, wedge_margin: int = 45, edge_ring: int = 130, speckle_area: int = 6000,
                        speckle_ecc: float = 0.90, off_args: dict | None = None) -> DataFrame:
    """Wedge with its margin, the specimen-edge ring, and round speckle left over from both."""
    wedge = large_regions(mask_where(smoothed(tiles, sigma, tile), "smooth", lambda v: v < dark_max), wedge_fraction, tile)
    off = off_specimen(tiles, tile, **(off_args or {}))
    zone = materialize(R.union(R.dilate(wedge, R.box(wedge_margin)), R.dilate(off, R.box(edge_ring))), "zone")
    lab = label_runs(R.subtract(predicted, zone), 8, tile=tile)
    speckle = G.region_props(lab).filter((F.col("area") <= speckle_area) & (F.col("ecc") < speckle_ecc))
    return R.union(zone, G.keep_regions(lab, speckle).select(*R.RUN))


def crack_cores(tiles: DataFrame, tile: int, sigma: float = 25.0, k: float = 2.2, min_area: int = 400, min_ecc: float = 0.85,
                erode: int = 0, max_fraction: float = 0.015, off_args: dict | None = None) -> DataFrame:
    """Locally dark, elongated regions inside the specimen; frames above the plausible share are dropped whole."""
    frames = frames_of(tiles)
    resid = materialize(H.apply_bands(tiles, int(K.TRUNCATE * sigma + 0.5), {"resid": lambda w: w.centre() - w.gauss(sigma)}, tile), "resid")
    specimen = R.complement(off_specimen(tiles, tile, **(off_args or {})), frames)
    if erode:
        specimen = R.erode(specimen, R.box(erode))
    specimen = materialize(specimen, "specimen")
    inside = R.to_pixels(specimen).join(pixels(resid, "resid"), ["image_id", "y", "x"])
    spread = inside.groupBy("image_id").agg(F.stddev_pop("resid").alias("_sd")).filter("_sd > 0")
    dark = inside.join(spread, "image_id").filter(F.col("resid") < -k * F.col("_sd"))
    closed = R.closing(R.from_pixels(dark.select("image_id", "fh", "fw", "y", "x")), R.box(2))
    lab = label_runs(closed, 8, tile=tile)
    p = G.region_props(lab).filter((F.col("area") >= min_area) & (F.col("ecc") >= min_ecc))
    total = p.groupBy("image_id").agg(F.sum("area").alias("_a"), F.first(F.col("fh") * F.col("fw")).alias("_n"))
    plausible = total.filter(F.col("_a") <= F.lit(max_fraction) * F.col("_n"))
    return G.keep_regions(lab, p).join(plausible.select("image_id"), "image_id", "left_semi")


def thick_cracks(tiles: DataFrame, tile: int, bright_min: float = 0.45, close: int = 25, min_area: int = 3000, min_ecc: float = 0.75,
                 dominance: float = 0.60, max_fraction: float = 0.30, open_radius: int = 2, column: str = "data") -> DataFrame:
    """Dark regions inside the specimen envelope, where one of them dominates its frame."""
    bright = materialize(mask_where(tiles, column, lambda v: v > bright_min), "bright")
    envelope = G.fill_holes(R.closing(largest_region(bright, tile), R.box(close)), tile=tile)
    cand = R.opening(R.subtract(envelope, bright), R.box(open_radius))
    lab = label_runs(cand, 8, tile=tile)
    p = G.region_props(lab).filter((F.col("area") >= min_area) & (F.col("ecc") >= min_ecc))
    per = p.groupBy("image_id").agg(F.max("area").alias("_m"), F.sum("area").alias("_a"), F.first(F.col("fh") * F.col("fw")).alias("_n"))
    ok = per.filter((F.col("_m") / F.col("_a") >= dominance) & (F.col("_a") <= F.lit(max_fraction) * F.col("_n")))
    return G.keep_regions(lab, p).join(ok.select("image_id"), "image_id", "left_semi")


def legacy_postprocess(prob_tiles: DataFrame, tile: int, sigma: float = 2.0, threshold: float = 0.5, close: int = 3, min_size: int = 150,
                       hole_max: int = 800, round_max: int = 5000, ecc_min: float = 0.5, low: float = 0.35, grow: int = 3,
                       fill: int = 500, border: int = 100) -> DataFrame:
    """Blur, threshold, close, drop specks and round or holed regions, grow, fill small holes, blank the border."""
    blur = materialize(smoothed(prob_tiles, sigma, tile), "blur")
    mask = R.closing(mask_where(blur, "smooth", lambda v: v >= threshold), R.disk(close), outside=True)
    mask = G.remove_small(mask, min_size, 4, tile=tile)
    kept = G.shape_filter(label_runs(mask, 8, tile=tile), hole_max, round_max, ecc_min).select(*R.RUN)
    kept = materialize(kept, "kept")
    grown = G.grow_into(kept, mask_where(blur, "smooth", lambda v: v >= low), grow)
    return R.border_blank(G.fill_holes(grown, max_area=fill, tile=tile), border)


def ridge_response(tiles: DataFrame, tile: int, sigmas=range(1, 6)) -> DataFrame:
    """Dark-ridge strength in [0, 1]: the energy scale and the final maximum are taken per frame, over all its tiles."""
    sigmas = list(sigmas)
    halo = int(K.TRUNCATE * max(sigmas) + 0.5)
    energy = {f"e{i}": (lambda w, s=s: K.hessian_energy(w, s)) for i, s in enumerate(sigmas)}
    top = H.apply_bands(tiles, halo, energy, tile)
    per = top.groupBy("image_id").agg(*[F.max(F.array_max(f"e{i}")).alias(f"g{i}") for i in range(len(sigmas))])
    names = [f"g{i}" for i in range(len(sigmas))]

    def strength(w, **g):
        return K.ridge(w, sigmas, [g[n] for n in names])

    out = materialize(H.apply_bands(tiles.join(per, "image_id"), halo, {"ridge": strength}, tile, names), "ridge")
    best = out.groupBy("image_id").agg(F.max(F.array_max("ridge")).alias("_top"))
    scaled = F.when(F.col("_top") > 0, F.transform("ridge", lambda v: v / F.col("_top"))).otherwise(F.col("ridge"))
    return out.drop(*names).join(best, "image_id").withColumn("ridge", scaled).drop("_top")
