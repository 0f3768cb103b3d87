"""Line profiles, border-defect repair and pitch detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scalars import soft_knee
from rasterloom.operators.quantiles import bounded_percentiles

SIDES = ("left", "right", "top", "bottom")


def line_profiles(px: DataFrame, value: str = "v") -> DataFrame:
    """Median of every row and column: (image_id, axis, pos, v); a line is bounded by the frame's side."""
    rows = bounded_percentiles(px, ["image_id", "y"], value, {"v": 0.5}).select("image_id", F.lit("row").alias("axis"), F.col("y").alias("pos"), "v")
    cols = bounded_percentiles(px, ["image_id", "x"], value, {"v": 0.5}).select("image_id", F.lit("col").alias("axis"), F.col("x").alias("pos"), "v")
    return rows.union(cols)


def border_fix(px: DataFrame, side: str, max_band: int = 40, ref_window: int = 30, knee_lo: float = 1.1, knee_hi: float = 1.8,
               blank_frac: float = 0.05, min_hits: int = 25, value: str = "v") -> DataFrame:
    """Repair the outer band of one side of pixels ``(image_id, fh, fw, y, x, v)``; adds the frame's ``hits`` to the band.

    Each line's reference is the median of the pixels just inside the band.  Frames with
    fewer than ``min_hits`` corrected pixels are left alone.
    """
    if side not in SIDES:
        raise ValueError(side)
    line, pos, size = ("y", "x", "fw") if side in ("left", "right") else ("x", "y", "fh")
    if side in ("left", "top"):
        in_band = F.col(pos) < max_band
        in_ref = (F.col(pos) >= max_band) & (F.col(pos) < max_band + ref_window)
    else:
        in_band = F.col(pos) >= F.col(size) - max_band
        in_ref = (F.col(pos) >= F.greatest(F.col(size) - max_band - ref_window, F.lit(0))) & (F.col(pos) < F.col(size) - max_band)
    ref = bounded_percentiles(px.filter(in_ref), ["image_id", line], value, {"_ref": 0.5})
    band = px.filter(in_band).join(ref, ["image_id", line], "left")
    floor = F.greatest(F.col("_ref") * blank_frac, F.lit(1e-6))
    live = F.col("_ref").isNotNull() & (F.col(value) >= floor)
    factor = F.when(live, soft_knee(F.col("_ref") / F.greatest(F.col(value), floor), knee_lo, knee_hi)).otherwise(1.0)
    band = band.withColumn("_f", factor)
    hits = band.groupBy("image_id").agg(F.count_if(F.abs(F.col("_f") - 1.0) > 0.02).alias("hits"))
    fixed = band.join(hits, "image_id").withColumn(value, F.when(F.col("hits") >= min_hits, F.col(value) * F.col("_f")).otherwise(F.col(value)))
    rest = px.filter(~in_band).withColumn("hits", F.lit(None).cast("long"))
    return fixed.drop("_ref", "_f").unionByName(rest)


def tile_pitch(px: DataFrame, axis: str, lo: int = 60, hi: int = 400, value: str = "v", min_corr: float = 0.05) -> DataFrame:
    """Lag of the greatest autocorrelation of the mean profile along ``axis``; NULL when weak or too short."""
    prof = px.groupBy("image_id", F.col(axis).alias("pos")).agg(F.avg(value).alias("m"))
    stat = prof.groupBy("image_id").agg(F.avg("m").alias("_mean"), F.count(F.lit(1)).alias("n"), F.stddev_pop("m").alias("_sd"))
    p = prof.join(stat, "image_id").filter((F.col("n") >= 2 * hi) & (F.col("_sd") > 0)).select(
        "image_id", "pos", (F.col("m") - F.col("_mean")).alias("m"))
    shifted = p.select("image_id", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias("lag"), "pos", F.col("m").alias("u"))
    shifted = shifted.withColumn("pos", F.col("pos") + F.col("lag"))
    ac = shifted.join(p, ["image_id", "pos"]).groupBy("image_id", "lag").agg(F.sum(F.col("u") * F.col("m")).alias("c"))
    zero = p.groupBy("image_id").agg(F.sum(F.col("m") * F.col("m")).alias("c0"))
    best = ac.join(zero, "image_id").withColumn("r", F.round(F.col("c") / (F.col("c0") + 1e-12), 9)).groupBy("image_id").agg(
        F.max_by("lag", F.struct("r", -F.col("lag"))).alias("lag"), F.max("r").alias("r"))
    frames = stat.select("image_id").join(best, "image_id", "left")
    return frames.select("image_id", F.when(F.col("r") > min_corr, F.col("lag")).alias("pitch"), "r")
