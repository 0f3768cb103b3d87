"""Frame and group aggregates: confusion counts, thresholds, quality checks and ring densities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.quantiles import bounded_percentiles, exact_percentiles


def confusion(df: DataFrame, keys: Sequence[str], predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn per group."""
    marked = df.withColumn("_p", predicted).withColumn("_t", actual)
    return marked.groupBy(*keys).agg(
        F.count_if(F.col("_p") & F.col("_t")).alias("tp"),
        F.count_if(F.col("_p") & ~F.col("_t")).alias("fp"),
        F.count_if(~F.col("_p") & F.col("_t")).alias("fn"),
        F.count_if(~F.col("_p") & ~F.col("_t")).alias("tn"))


def otsu(df: DataFrame, keys: Sequence[str], value: str, bins: int = 256) -> DataFrame:
    """Threshold of greatest between-class variance per group.

    The histogram is counted with map-side combine; everything after it works on at most
    ``bins`` rows per group.  Empty bins cannot win, since they repeat the variance of the
    occupied bin before them, so the sparse histogram is enough.
    """
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_no = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins),
                                       F.lit(bins - 1))).otherwise(0)
    hist = df.join(span, keys).groupBy(*keys, bin_no.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_c"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    hist = hist.withColumn("_centre", F.col("_lo") + (F.col("_bin") + 0.5) * width)
    up = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    mass = F.col("_c") * F.col("_centre")
    h = (hist.withColumn("_w1", F.sum("_c").over(up)).withColumn("_m1", F.sum(mass).over(up))
         .withColumn("_w", F.sum("_c").over(all_)).withColumn("_m", F.sum(mass).over(all_))
         .withColumn("_n", F.count(F.lit(1)).over(all_)))
    w2 = F.col("_w") - F.col("_w1")
    gap = F.col("_m1") / F.col("_w1") - (F.col("_m") - F.col("_m1")) / w2
    h = h.withColumn("_var", F.when(w2 > 0, F.round(F.col("_w1") * w2 * gap * gap, 9)))
    single = F.col("_n") == 1
    best = F.struct(F.coalesce("_var", F.lit(-1.0)), -F.col("_bin"))
    return h.groupBy(*keys).agg(F.max_by(F.when(single, F.col("_lo")).otherwise(F.col("_centre")), best).alias("threshold"))


def dark_threshold(df: DataFrame, keys: Sequence[str], value: str, mad_k: float = 5.0, bounded: bool = False) -> DataFrame:
    """min(otsu, median - k * 1.4826 * MAD) per group."""
    keys = list(keys)
    pct = bounded_percentiles if bounded else exact_percentiles
    med = pct(df, keys, value, {"median": 0.5})
    dev = df.join(med, keys).withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    mad = pct(dev, keys, "_dev", {"mad": 0.5})
    j = otsu(df, keys, value).join(med, keys).join(mad, keys)
    return j.select(*keys, "median", "mad", F.least(
        F.col("threshold"), F.col("median") - F.col("mad") * (mad_k * 1.4826)).alias("threshold"))


def flatness_check(df: DataFrame, keys: Sequence[str], value: str, specimen_min: float = 0.25, iqr_max: float = 0.10,
                   bright_min: float = 0.70, min_pixels: int = 1000, bounded: bool = False) -> DataFrame:
    """Quartiles of the specimen interior and the reasons a frame fails."""
    keys = list(keys)
    pct = bounded_percentiles if bounded else exact_percentiles
    body = df.filter(F.col(value) > specimen_min)
    size = df.groupBy(*keys).agg(F.count_if(F.col(value) > specimen_min).alias("n_body"))
    j = size.join(pct(body, keys, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}), keys, "left")
    iqr = F.col("p75") - F.col("p25")
    small = F.col("n_body") < min_pixels
    reason = F.concat_ws("; ", F.when(iqr > iqr_max, "iqr"), F.when(F.col("p50") < bright_min, "dark"))
    reason = F.when(small, "too few interior pixels").otherwise(F.when(reason != "", reason))
    return j.select(*keys, "n_body", F.when(~small, F.col("p50")).alias("brightness"),
                    F.when(~small, iqr).alias("iqr"), reason.alias("reason"), reason.isNull().alias("ok"))


def ring_density(masks: DataFrame, frames: DataFrame, bands: Sequence[tuple[int, int]]) -> DataFrame:
    """Mask density in the cross-shaped border ring of each band; rows (image_id, band, density).

    ``masks`` are mask pixels only; ring areas follow from the frame size.
    """
    def hit(c: Column, size: Column, lo: int, hi: int) -> Column:
        return ((c >= lo) & (c < hi)) | ((c >= size - hi) & (c < size - lo))

    def lines(size: Column, lo: int, hi: int) -> Column:
        first = F.greatest(F.least(F.lit(hi), size) - lo, F.lit(0))
        overlap = F.greatest(F.least(F.lit(hi), size - lo) - F.greatest(F.lit(lo), size - hi), F.lit(0))
        return first * 2 - overlap

    h, w = F.col("height"), F.col("width")
    per = masks.join(frames, "image_id").groupBy("image_id").agg(*[
        F.count_if(hit(F.col("y"), h, lo, hi) | hit(F.col("x"), w, lo, hi)).alias(f"_n{i}")
        for i, (lo, hi) in enumerate(bands)])
    j = frames.join(per, "image_id", "left")
    cells = []
    for i, (lo, hi) in enumerate(bands):
        r, c = lines(h, lo, hi), lines(w, lo, hi)
        area = r * w + c * h - r * c
        cells.append(F.struct(F.lit(f"{lo}-{hi}").alias("band"),
                              F.coalesce(F.try_divide(F.coalesce(F.col(f"_n{i}"), F.lit(0)), area), F.lit(0.0)).alias("density")))
    return j.select("image_id", F.inline(F.array(*cells)))


def raster_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Correlation and mean absolute z-score difference of two rasters with columns (image_id, y, x, v)."""
    j = a.join(b.withColumnRenamed("v", "u"), ["image_id", "y", "x"])
    s = j.groupBy("image_id").agg(F.avg("v").alias("mv"), F.stddev_pop("v").alias("sv"), F.avg("u").alias("mu"),
                                  F.stddev_pop("u").alias("su"), F.corr("v", "u").alias("corr"))
    z = F.abs(F.try_divide(F.col("v") - F.col("mv"), F.col("sv")) - F.try_divide(F.col("u") - F.col("mu"), F.col("su")))
    return j.join(s, "image_id").groupBy("image_id").agg(F.first("corr").alias("corr"), F.avg(z).alias("mean_z_diff"))
