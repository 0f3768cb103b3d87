"""Masks as horizontal runs, and their algebra.

A mask is the table ``(image_id, fh, fw, y, x0, x1)``: maximal runs of set pixels per
frame row, with the frame size carried along.  Union, intersection, difference,
complement, dilation and erosion are all one weighted interval sweep per frame row, so
each costs a single shuffle on (image_id, y) and never enumerates pixels.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = ["image_id", "fh", "fw", "y"]
RUN = ROW + ["x0", "x1"]


def from_pixels(px: DataFrame) -> DataFrame:
    """Pixels ``(image_id, fh, fw, y, x)`` to maximal runs."""
    w = Window.partitionBy("image_id", "y").orderBy("x")
    island = px.select(*ROW, "x").withColumn("_g", F.col("x") - F.row_number().over(w))
    return island.groupBy(*ROW, "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def to_pixels(runs: DataFrame, *extra: str) -> DataFrame:
    """Pixels of runs; joins sort and merge them, since a size estimate sees the few runs and would broadcast their many pixels."""
    return runs.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), *extra).hint("merge")


def sweep(weighted: DataFrame, need: Column | int) -> DataFrame:
    """Maximal intervals where the summed weight ``_w`` of the covering intervals reaches ``need``.

    ``need`` may depend on the row columns.
    """
    ends = weighted.select(*ROW, F.inline(F.array(
        F.struct(F.col("x0").alias("_p"), F.col("_w").alias("_d")),
        F.struct((F.col("x1") + 1).alias("_p"), (-F.col("_w")).alias("_d")))))
    w = Window.partitionBy("image_id", "y").orderBy("_p")
    need = F.lit(need) if isinstance(need, int) else need
    on = ends.withColumn("_on", F.sum("_d").over(w.rangeBetween(Window.unboundedPreceding, 0)) >= need)
    turn = on.withColumn("_was", F.coalesce(F.lag("_on").over(w), F.lit(False))).filter("_on <> _was")
    out = turn.withColumn("_next", F.lead("_p").over(w)).filter("_on")
    return out.select(*ROW, F.col("_p").cast("int").alias("x0"), (F.col("_next") - 1).cast("int").alias("x1"))


def _weight(runs: DataFrame, weight: int) -> DataFrame:
    return runs.select(*RUN, F.lit(weight).alias("_w"))


def union(*masks: DataFrame) -> DataFrame:
    out = _weight(masks[0], 1)
    for m in masks[1:]:
        out = out.unionByName(_weight(m, 1))
    return sweep(out, 1)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep(_weight(a, 1).unionByName(_weight(b, 1)), 2)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep(_weight(a, 1).unionByName(_weight(b, -1)), 1)


def full_rows(frames: DataFrame) -> DataFrame:
    """Every row of every frame ``(image_id, fh, fw)`` as one run."""
    rows = frames.select("image_id", "fh", "fw", F.explode(F.sequence(F.lit(0), F.col("fh") - 1)).alias("y"))
    return rows.select(*ROW, F.lit(0).alias("x0"), (F.col("fw") - 1).alias("x1"))


def complement(runs: DataFrame, frames: DataFrame) -> DataFrame:
    return sweep(_weight(full_rows(frames), 1).unionByName(_weight(runs, -1)), 1)


def disk(radius: int) -> list[tuple[int, int]]:
    """Rows of a disk footprint: (dy, half width)."""
    return [(dy, isqrt(radius * radius - dy * dy)) for dy in range(-radius, radius + 1)]


def box(radius: int) -> list[tuple[int, int]]:
    """A (2r+1)-square, which equals r iterations of a 3x3 square."""
    return [(dy, radius) for dy in range(-radius, radius + 1)]


def cross(radius: int = 1) -> list[tuple[int, int]]:
    return [(dy, radius if dy == 0 else 0) for dy in range(-radius, radius + 1)]


def _footprint(shape: Sequence[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(hw).alias("hw")) for dy, hw in shape])


def dilate(runs: DataFrame, shape: Sequence[tuple[int, int]]) -> DataFrame:
    """Every run spreads to the rows of the footprint; clipped to the frame."""
    spread = runs.withColumn("_s", F.explode(_footprint(shape)))
    spread = spread.select(
        "image_id", "fh", "fw", (F.col("y") + F.col("_s.dy")).alias("y"),
        F.greatest(F.col("x0") - F.col("_s.hw"), F.lit(0)).alias("x0"),
        F.least(F.col("x1") + F.col("_s.hw"), F.col("fw") - 1).alias("x1"), F.lit(1).alias("_w"))
    return sweep(spread.filter("y >= 0 AND y < fh"), 1)


def erode(runs: DataFrame, shape: Sequence[tuple[int, int]], outside: bool = False) -> DataFrame:
    """A pixel stays if every footprint row around it lies in a run shrunk by that row's half width.

    ``outside`` states whether pixels beyond the frame count as set.
    """
    shrunk = runs.withColumn("_s", F.explode(_footprint(shape)))
    hw = F.col("_s.hw")
    lo, hi = F.col("x0") + hw, F.col("x1") - hw
    if outside:
        lo = F.when(F.col("x0") == 0, 0).otherwise(lo)
        hi = F.when(F.col("x1") == F.col("fw") - 1, F.col("fw") - 1).otherwise(hi)
    shrunk = shrunk.select("image_id", "fh", "fw", (F.col("y") - F.col("_s.dy")).alias("y"),
                           lo.alias("x0"), hi.alias("x1"), F.lit(1).alias("_w"))
    shrunk = shrunk.filter("x0 <= x1 AND y >= 0 AND y < fh")
    if not outside:
        return sweep(shrunk, len(shape))
    top, bottom = min(d for d, _ in shape), max(d for d, _ in shape)
    present = (F.least(F.col("y") + bottom, F.col("fh") - 1) - F.greatest(F.col("y") + top, F.lit(0)) + 1)
    return sweep(shrunk, present)


def opening(runs: DataFrame, shape, outside: bool = False) -> DataFrame:
    return dilate(erode(runs, shape, outside), shape)


def closing(runs: DataFrame, shape, outside: bool = False) -> DataFrame:
    return erode(dilate(runs, shape), shape, outside)


def border_blank(runs: DataFrame, margin: int) -> DataFrame:
    cut = runs.withColumns({"x0": F.greatest("x0", F.lit(margin)), "x1": F.least("x1", F.col("fw") - 1 - margin)})
    return cut.filter((F.col("x0") <= F.col("x1")) & (F.col("y") >= margin) & (F.col("y") < F.col("fh") - margin))
