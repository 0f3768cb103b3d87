"""Pixel-local operators: normalisation, masks, overlays and field-of-view detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scalars import clip, stretch
from rasterloom.operators.ordered import sliding
from rasterloom.operators.quantiles import array_percentile, exact_percentiles

PIXEL = ("image_id", "y", "x")


def normalize_tiles(tiles: DataFrame, plo: float = 0.01, phi: float = 0.99, data: str = "data") -> DataFrame:
    """Robust stretch of frames held in one array each; narrow, no shuffle."""
    srt = F.array_sort(data)
    with_lim = tiles.withColumn("_s", srt).withColumn("_lo", array_percentile(F.col("_s"), plo)).withColumn(
        "_hi", array_percentile(F.col("_s"), phi)).withColumn("_mn", F.get("_s", F.lit(0))).withColumn(
        "_mx", F.get("_s", F.size("_s") - 1))
    out = F.transform(data, lambda v: stretch(v, F.col("_lo"), F.col("_hi"), F.col("_mn"), F.col("_mx")))
    return with_lim.withColumn(data, out).drop("_s", "_lo", "_hi", "_mn", "_mx")


def normalize_rows(px: DataFrame, value: str = "v", plo: float = 0.01, phi: float = 0.99,
                   keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Robust stretch of frames of any size, from pixel rows."""
    keys = list(keys)
    lim = exact_percentiles(px, keys, value, {"_lo": plo, "_hi": phi, "_mn": 0.0, "_mx": 1.0})
    return px.join(lim, keys).withColumn(
        value, stretch(F.col(value), F.col("_lo"), F.col("_hi"), F.col("_mn"), F.col("_mx"))
    ).drop("_lo", "_hi", "_mn", "_mx")


def tile_pixels(tiles: DataFrame, columns: Sequence[str] = ("data",), names: Sequence[str] = ("v",)) -> DataFrame:
    """Dense tiles to pixel rows; several arrays of one tile come out as several columns."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    rows = tiles.select("image_id", "y0", "x0", "w", F.posexplode(zipped).alias("_i", "_z"))
    return rows.select(
        "image_id",
        (F.col("y0") + F.floor(F.col("_i") / F.col("w"))).cast("int").alias("y"),
        (F.col("x0") + F.col("_i") % F.col("w")).cast("int").alias("x"),
        *[F.col(f"_z.{c}").alias(n) for c, n in zip(columns, names)],
    )


def display_limits(px: DataFrame, support: Column, value: str = "v", min_pixels: int = 1000) -> DataFrame:
    """1st and 99th percentile over supported pixels, with the whole-frame and degenerate fallbacks."""
    v = px.withColumn("_d", clip(F.col(value), 0.0, 1.0)).withColumn("_s", support)
    inside = exact_percentiles(v.filter("_s"), ["image_id"], "_d", {"s_lo": 0.01, "s_hi": 0.99})
    whole = exact_percentiles(v, ["image_id"], "_d", {"w_lo": 0.01, "w_hi": 0.99})
    sizes = v.groupBy("image_id").agg(F.count_if("_s").alias("n_support"))
    j = sizes.join(whole, "image_id").join(inside, "image_id", "left")
    use = F.col("n_support") >= min_pixels
    lo, hi = F.when(use, F.col("s_lo")).otherwise(F.col("w_lo")), F.when(use, F.col("s_hi")).otherwise(F.col("w_hi"))
    flat = (hi - lo) < 1e-4
    return j.select("image_id", "n_support", F.when(flat, 0.0).otherwise(lo).alias("lo"),
                    F.when(flat, 1.0).otherwise(hi).alias("hi"))


def common_window(px: DataFrame, value: str = "v") -> DataFrame:
    """One display window pooled over frames, and how each frame sits in it."""
    live = px.filter(F.col(value) != 0)
    window = exact_percentiles(live, [], value, {"lo": 0.01, "hi": 0.99})
    lo, hi = window.select("lo").scalar(), window.select("hi").scalar()
    spread = exact_percentiles(live, ["image_id"], value, {"q1": 0.25, "med": 0.5, "q3": 0.75})
    clipped = live.groupBy("image_id").agg(
        F.avg(((F.col(value) < lo) | (F.col(value) > hi)).cast("double")).alias("clipped"))
    return clipped.join(spread, "image_id").select(
        "image_id", lo.alias("lo"), hi.alias("hi"), F.col("med").alias("median"),
        (F.col("q3") - F.col("q1")).alias("iqr"), "clipped")


def overlay(base: DataFrame, labels: DataFrame, value: str = "is_pos") -> DataFrame:
    """Full-outer overlay of sparse labels: state 1 forces true, 2 forces false."""
    j = base.select(*PIXEL, value).join(labels.select(*PIXEL, "state"), list(PIXEL), "full")
    return j.select(*PIXEL, F.when(F.col("state") == 1, True).when(F.col("state") == 2, False)
                    .otherwise(F.coalesce(F.col(value), F.lit(False))).alias(value))


def colour_delta(img: DataFrame, template: DataFrame, colour: Sequence[int], radius: float = 40.0) -> DataFrame:
    """Pixels newly near ``colour`` that were not near it in the template."""
    def near(side: str) -> Column:
        d2 = sum(F.pow(F.col(f"{side}.{c}") - F.lit(float(k)), 2) for c, k in zip("rgb", colour))
        return F.sqrt(d2) < radius

    j = img.alias("a").join(template.alias("b"), list(PIXEL), "left")
    return j.filter(near("a") & ~F.coalesce(near("b"), F.lit(False))).select(*PIXEL)


def inferred_polarity(px: DataFrame, value: str = "v") -> DataFrame:
    """Read a 0/255 mask whose polarity is unknown: the minority value is positive."""
    dark = F.col(value) < 128
    share = px.groupBy("image_id").agg(F.avg(dark.cast("double")).alias("_share"))
    return px.join(share, "image_id").withColumn(
        "is_pos", F.when(F.col("_share") <= 0.5, dark).otherwise(~dark)).drop("_share")


def row_signal(px: DataFrame, value: str = "v") -> DataFrame:
    """Mean and population deviation per row of each frame."""
    return px.groupBy("image_id", "y").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def databar_top(px: DataFrame, frames: DataFrame, value: str = "v", search_frac: float = 0.25, window: int = 10,
                sd_ratio: float = 0.4, mean_ratio: float = 0.85) -> DataFrame:
    """First row in the lower part of a frame where both deviation and mean drop against the rows above."""
    start = F.floor(F.col("height") * (1 - search_frac)).cast("int")
    sig = row_signal(px, value).join(frames.select("image_id", "height"), "image_id").filter(F.col("y") >= start)
    sig = sig.withColumn("_rel", F.col("y") - start)
    sig = sliding(sig, ["image_id"], "y", window, -1, {"_bs": F.max("sd"), "_bm": F.max("mean")})
    drop = (F.col("_bs") > 3) & (F.col("sd") < F.col("_bs") * sd_ratio) & (F.col("mean") < F.col("_bm") * mean_ratio)
    first = sig.filter((F.col("_rel") >= window) & drop).groupBy("image_id").agg(F.min("y").alias("_bar"))
    long_enough = F.col("height") - start >= window + 5
    return frames.join(first, "image_id", "left").withColumn(
        "bar_top", F.when(long_enough, F.coalesce("_bar", "height")).otherwise(F.col("height"))).drop("_bar")


def field_of_view(px: DataFrame, frames: DataFrame, value: str = "v", bright: float = 12.0,
                  shrink: float = 0.16, min_keep: float = 0.2) -> DataFrame:
    """Usable window of each frame below no info bar and inside the vignette."""
    bars = databar_top(px, frames, value).select("image_id", "height", "width", "bar_top")
    work = px.join(bars, "image_id").filter(F.col("y") < F.col("bar_top"))
    rows = work.groupBy("image_id", "y").agg(F.avg(value).alias("m")).filter(F.col("m") > bright)
    cols = work.groupBy("image_id", "x").agg(F.avg(value).alias("m")).filter(F.col("m") > bright)
    box = rows.groupBy("image_id").agg(F.min("y").alias("y0"), F.max("y").alias("y1")).join(
        cols.groupBy("image_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1")), "image_id")
    j = bars.join(box, "image_id", "left")
    h, w, bar = F.col("height"), F.col("width"), F.col("bar_top")
    full = F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), w.alias("x1"), bar.alias("y1"))
    fills = ((F.col("x1") - F.col("x0")) > 0.97 * w) & ((F.col("y1") - F.col("y0")) > 0.97 * bar)
    cy, cx = (F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2
    half = F.greatest(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")) / 2 / F.sqrt(F.lit(2.0)) * (1 - shrink)

    def trunc(c: Column) -> Column:
        return c.cast("int")

    square = F.struct(
        F.greatest(trunc(cx - half), F.lit(0)).alias("x0"), F.greatest(trunc(cy - half), F.lit(0)).alias("y0"),
        F.least(trunc(cx + half), w).alias("x1"), F.least(trunc(cy + half), bar).alias("y1"))
    pick = F.when(F.col("y0").isNull() | fills, full).otherwise(square)
    area = (F.col("_b.x1") - F.col("_b.x0")) * (F.col("_b.y1") - F.col("_b.y0"))
    out = j.withColumn("_b", pick)
    out = out.withColumn("_b", F.when(area < min_keep * w * h, full).otherwise(F.col("_b")))
    return out.select("image_id", "bar_top", "_b.x0", "_b.y0", "_b.x1", "_b.y1")
