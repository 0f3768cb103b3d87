"""Scores and paired statistics, all from confusion counts or paired tables."""

from __future__ import annotations

from collections.abc import Sequence

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.functions.scalars import iou, ratio_or_zero
from rasterloom.operators.ordered import running_total


def overlap_scores(counts: DataFrame, empty=None) -> DataFrame:
    """IoU, Dice, precision and recall from tp, fp, fn; ``empty`` is the IoU of an empty union."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "iou": iou(tp, fp, fn, empty), "dice": F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)),
        "precision": ratio_or_zero(tp, tp + fp), "recall": ratio_or_zero(tp, tp + fn)})


def roc_points(df: DataFrame, keys: Sequence[str], score: str, actual: Column, buckets: int = 1024) -> DataFrame:
    """Cumulative tp and fp at every distinct score, highest first; scores lie in [0, 1]."""
    ties = df.groupBy(*keys, score).agg(F.count_if(actual).alias("_pos"), F.count_if(~actual).alias("_neg"))
    return running_total(ties, keys, F.floor(-F.col(score) * buckets), [F.desc(score)], {"tp": "_pos", "fp": "_neg"})


def threshold_free(df: DataFrame, keys: Sequence[str], score: str, actual: Column, targets: Sequence[float] = (0.05, 0.10)) -> DataFrame:
    """ROC AUC with ties counted half, and recall at fixed false-positive rates by linear interpolation."""
    keys = list(keys)
    pts = roc_points(df, keys, score, actual)
    tot = pts.groupBy(*keys).agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    j = pts.join(tot, keys)
    aggs = [F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"),
            F.sum(F.col("_pos") * (F.col("n_neg") - F.col("fp") + F.col("_neg") / 2)).alias("_area")]
    at = F.struct("fp", "tp")
    for i, t in enumerate(targets):
        rate = F.try_divide(F.col("fp"), F.col("n_neg"))
        aggs += [F.max(F.when(rate <= t, at)).alias(f"_a{i}"), F.min(F.when(rate > t, at)).alias(f"_b{i}")]
    out = j.groupBy(*keys).agg(*aggs)
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    cols = [F.when(both, F.try_divide(F.col("_area"), F.col("n_pos") * F.col("n_neg"))).alias("auc")]
    for i, t in enumerate(targets):
        fa = F.try_divide(F.coalesce(F.col(f"_a{i}.fp"), F.lit(0)), F.col("n_neg"))
        ta = F.try_divide(F.coalesce(F.col(f"_a{i}.tp"), F.lit(0)), F.col("n_pos"))
        fb, tb = F.try_divide(F.col(f"_b{i}.fp"), F.col("n_neg")), F.try_divide(F.col(f"_b{i}.tp"), F.col("n_pos"))
        value = F.when(F.col(f"_b{i}").isNull(), ta).otherwise(ta + F.try_divide((tb - ta) * (F.lit(t) - fa), fb - fa))
        cols.append(F.when(both, value).alias(f"r{int(round(t * 100)):02d}"))
    return out.select(*keys, *cols)


def choose_half_tail(n: Column, lo: Column) -> Column:
    """Sum of C(n, i) for i in 0..lo, as a double; each term follows from the one before."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(lo >= 1, F.sequence(F.lit(1).cast("long"), lo.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, step, lambda acc: acc["total"])


def sign_test(deltas: DataFrame, keys: Sequence[str], delta: str = "delta") -> DataFrame:
    """Exact two-sided sign test over non-zero deltas."""
    c = deltas.groupBy(*keys).agg(F.count_if(F.col(delta) > 0).alias("wins"), F.count_if(F.col(delta) != 0).alias("n_nonzero"))
    n = F.col("n_nonzero")
    lo = F.least(F.col("wins"), n - F.col("wins"))
    p = F.least(F.lit(1.0), F.lit(2.0) * choose_half_tail(n, lo) / F.pow(F.lit(2.0), n))
    return c.withColumn("p_sign", F.when(n == 0, 1.0).otherwise(p))


def wilcoxon(deltas: DataFrame, keys: Sequence[str], delta: str = "delta", method: str = "exact") -> DataFrame:
    """Signed-rank test with p from the exact null distribution, or from the normal one if ``method`` is "normal".

    The exact distribution is that of the ranks as they are, mid-ranks of ties included.  It takes a number of steps
    of the pairs of a key times the statistic.  The method is a column of the result.
    """
    if method not in ("exact", "normal"):
        raise ValueError("method must be exact or normal")
    keys = list(keys)
    d = deltas.filter(F.col(delta) != 0).withColumn("_a", F.abs(delta))
    w = Window.partitionBy(*keys)
    low = F.rank().over(w.orderBy("_a"))
    tied = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_a"))
    d = d.withColumn("_t", tied).withColumn("_r", low + (F.col("_t") - 1) / 2.0)
    s = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(delta) > 0, F.col("_r")).otherwise(0.0)).alias("_plus"),
        F.sum("_r").alias("_all"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"), *([F.collect_list("_r").alias("_ranks")] if method == "exact" else []))
    n = F.col("n")
    stat = F.least(F.col("_plus"), F.col("_all") - F.col("_plus"))
    if method == "normal":
        sd = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_ties") / 2) / 24)
        p = normal_two_sided(F.abs((stat - n * (n + 1) / 4) / sd))
        return s.select(*keys, "n", stat.alias("statistic"), p.alias("p_wilcoxon"), F.lit(method).alias("method"))
    tail = signed_rank_tail(F.col("_ranks"), stat)
    return s.select(*keys, "n", stat.alias("statistic"), F.least(F.lit(1.0), 2.0 * tail).alias("p_wilcoxon"), F.lit(method).alias("method"))


@partial(F.pandas_udf, returnType=T.DoubleType())
def signed_rank_tail(ranks: pd.Series, statistic: pd.Series) -> pd.Series:
    """Probability that the positive ranks sum to at most the statistic, if every sign is a coin toss.

    Sums are counted in half ranks, and each step halves the weights, so any number of pairs stays in range.
    """
    def tail(held, top):
        top = int(round(2 * top))
        ways = np.zeros(top + 1)
        ways[0] = 1.0
        for r in np.rint(2 * np.sort(np.asarray(held, float))).astype(int).tolist():
            ways *= 0.5
            if r <= top:
                ways[r:] += ways[:top + 1 - r].copy()
        return ways.sum()

    return pd.Series([tail(h, t) for h, t in zip(ranks, statistic)], dtype=float)


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal tail by the five-term rational approximation (error below 1.5e-7)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * z)
    # The coefficients of the approximation.
    poly = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = poly * t + F.lit(c)
    return F.lit(2.0) * poly * t * F.exp(-z * z / 2) / F.sqrt(F.lit(2.0) * F.pi())


def paired_summary(deltas: DataFrame, keys: Sequence[str], delta: str = "delta") -> DataFrame:
    """Mean difference, its spread, standard error and t."""
    sd, n = F.stddev_samp(delta), F.count(delta)
    out = deltas.groupBy(*keys).agg(F.avg(delta).alias("mean_delta"), F.when(n > 1, sd).alias("sd_delta"), n.alias("n"))
    se = F.col("sd_delta") / F.sqrt("n")
    return out.withColumn("se", se).withColumn("t", F.when(F.col("se") > 0, F.col("mean_delta") / F.col("se")))
