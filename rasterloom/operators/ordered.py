"""Ordered operators over large groups: trailing windows, previous rows and running totals.

A window over a whole frame or recipe orders that group in one task.  These helpers cut
the order into blocks, give each block the rows it needs from its neighbours (or the one
aggregate it needs from all earlier blocks), and so stay parallel inside a hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_blocks(df: DataFrame, pos: str, before: int, after: int, block: int = 4096) -> DataFrame:
    """Copy each row into every block whose window can see it; ``_own`` marks the row's home block."""
    own = F.floor(F.col(pos) / block)
    first, last = F.floor((F.col(pos) - after) / block), F.floor((F.col(pos) + before) / block)
    return df.withColumn("_own", own).withColumn("_blk", F.explode(F.sequence(first, last)))


def sliding(df: DataFrame, keys: Sequence[str], pos: str, before: int, after: int,
            aggs: dict[str, Column], block: int = 4096) -> DataFrame:
    """Aggregates over positions ``[pos - before, pos + after]`` of each group."""
    w = Window.partitionBy(*keys, "_blk").orderBy(pos).rangeBetween(-before, after)
    out = with_blocks(df, pos, max(before, 0), max(after, 0), max(block, before + after + 1))
    for name, agg in aggs.items():
        out = out.withColumn(name, agg.over(w))
    return out.filter("_own = _blk").drop("_own", "_blk")


def previous_value(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: str,
                   out: str = "previous") -> DataFrame:
    """Last non-null value of the rows before, in ``order``, within each group.

    ``bucket`` must grow with ``order`` (a month, a day); only the last value of each bucket
    crosses bucket borders, so no group is ordered whole.
    """
    keys = list(keys)
    src = df.withColumn("_k", bucket)
    rank = F.struct(*order)
    seen = F.when(F.col(value).isNotNull(), rank)
    tail = src.groupBy(*keys, "_k").agg(F.max_by(value, seen).alias("_tail"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    carry = F.last("_tail", ignorenulls=True).over(earlier(Window.partitionBy(*keys).orderBy("_k")))
    tail = tail.withColumn("_carry", carry).drop("_tail")
    near = F.last(value, ignorenulls=True).over(earlier(Window.partitionBy(*keys, "_k").orderBy(*order)))
    return src.join(tail, keys + ["_k"]).withColumn(out, F.coalesce(near, "_carry")).drop("_k", "_carry")


def running_total(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums ``{output: input}`` within each group, exact and parallel by bucket.

    ``bucket`` must be monotone in the ascending ``order``.
    """
    keys = list(keys)
    src = df.withColumn("_k", bucket)
    per = src.groupBy(*keys, "_k").agg(*[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    for o in sums:
        per = per.withColumn(f"_b_{o}", F.coalesce(F.sum(f"_s_{o}").over(earlier), F.lit(0))).drop(f"_s_{o}")
    j = src.join(per, keys + ["_k"])
    w = Window.partitionBy(*keys, "_k").orderBy(*order)
    for o, c in sums.items():
        j = j.withColumn(o, F.col(f"_b_{o}") + F.sum(c).over(w.rangeBetween(Window.unboundedPreceding, 0)
                                                             if len(order) == 1 else
                                                             w.rowsBetween(Window.unboundedPreceding, 0)))
    return j.drop("_k", *[f"_b_{o}" for o in sums])
