"""Exact linear-interpolated percentiles that do not depend on one group fitting in one task.

``percentile`` ships every distinct value of a group to one aggregation buffer.  For a
frame of tens of megapixels, or a source that holds a third of all rows, that is one
hot task.  ``exact_percentiles`` first counts a fixed number of value bins per group
(map-side combined), then ranks only the few bins that contain a wanted rank.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 2048


def array_percentile(sorted_array: Column, q: float) -> Column:
    """Percentile of an already sorted array column; no shuffle for frames held in one row."""
    pos = F.lit(float(q)) * (F.size(sorted_array) - 1)
    k = F.floor(pos).cast("int")
    low = F.get(sorted_array, k)
    high = F.get(sorted_array, F.least(k + 1, F.size(sorted_array) - 1))
    return low + (high - low) * (pos - k)


def bounded_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """One aggregate, for groups whose size is bounded by construction (a tile, a line)."""
    return df.groupBy(*keys).agg(*[F.percentile(value, q).alias(n) for n, q in probs.items()])


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], bins: int = BINS
) -> DataFrame:
    """One row per group with the requested percentiles; NULL and NaN values are ignored.

    ``keys`` may be empty for a global percentile.
    """
    keys = list(keys)
    whole = not keys
    if whole:
        keys = ["_all"]
        df = df.withColumn("_all", F.lit(0))
    src = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    span = src.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_n"))
    scaled = F.when(F.col("_hi") > F.col("_lo"),
                    F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)).otherwise(0)
    binned = src.join(span, keys).withColumn("_bin", F.least(scaled, F.lit(bins - 1)).cast("int"))
    hist = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    hist = hist.withColumn("_before", F.sum("_c").over(by_bin.rowsBetween(Window.unboundedPreceding, -1)))
    hist = hist.withColumn("_before", F.coalesce("_before", F.lit(0)))

    ranks = []
    for q in sorted(set(probs.values())):
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        ranks += [F.floor(pos), F.ceil(pos)]
    wanted = F.exists(F.array(*ranks), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))
    hit = hist.filter(wanted).select(*keys, "_bin", "_before")

    ties = binned.join(hit, keys + ["_bin"]).groupBy(*keys, "_bin", "_v").agg(
        F.count(F.lit(1)).alias("_c"), F.first("_before").alias("_before"), F.first("_n").alias("_n"))
    by_value = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ties = ties.withColumn("_end", F.col("_before") + F.sum("_c").over(by_value))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end")), F.col("_v")))

    aggs, outs = [], []
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        aggs += [at(F.floor(pos)).alias(f"_a_{name}"), at(F.ceil(pos)).alias(f"_b_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"_f_{name}")]
        a, b, f = F.col(f"_a_{name}"), F.col(f"_b_{name}"), F.col(f"_f_{name}")
        outs.append((a + (b - a) * f).alias(name))
    out = ties.groupBy(*keys).agg(*aggs).select(*keys, *outs)
    return out.drop("_all") if whole else out
