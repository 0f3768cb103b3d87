"""Choosing among proposed masks: by darkness, by purity, and prompts drawn from known regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.ordered import running_total
from rasterloom.operators.quantiles import exact_percentiles
from rasterloom.operators.sampling import hash_order, take_by_hash
from rasterloom.session import materialize

PIXEL = ["image_id", "y", "x"]


def select_by_darkness(proposals: DataFrame, px: DataFrame, frames: DataFrame, q: float = 0.5, max_area: float = 0.5, value: str = "v") -> DataFrame:
    """Union of the proposals whose mean is below the frame's q-quantile and that are not too large."""
    limit = exact_percentiles(px, ["image_id"], value, {"_q": q}).join(frames, "image_id")
    per = proposals.join(px.select(*PIXEL, value), PIXEL).groupBy("image_id", "proposal").agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_a"))
    keep = per.join(limit, "image_id").filter((F.col("_m") < F.col("_q")) & (F.col("_a") <= F.lit(max_area) * F.col("fh") * F.col("fw")))
    return proposals.join(keep.select("image_id", "proposal"), ["image_id", "proposal"], "left_semi").select(*PIXEL).distinct()


def proposal_purity(proposals: DataFrame, truth: DataFrame) -> DataFrame:
    t = truth.select(*PIXEL).withColumn("_t", F.lit(1))
    return proposals.join(t, PIXEL, "left").groupBy("image_id", "proposal").agg(
        F.count(F.lit(1)).alias("area"), F.count("_t").alias("overlap")).withColumn("purity", F.col("overlap") / F.col("area"))


def _fresh(left: DataFrame, taken: DataFrame) -> DataFrame:
    """Pixels and true pixels of every proposal that no taken proposal before it holds: (image_id, at, n, pos)."""
    held = left.join(taken.select("image_id", "at"), ["image_id", "at"], "left_semi").groupBy("image_id", "sid").agg(F.min("at").alias("_by"))
    own = left.join(held, ["image_id", "sid"], "left").filter("_by IS NULL OR _by >= at")
    return own.groupBy("image_id", "at").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def _walk(ranked: DataFrame, left: DataFrame, taken: DataFrame) -> DataFrame:
    """Every proposal judged as if just the ``taken`` ones before it were in the union: (..., iou, _take)."""
    now = taken.select("image_id", "at", F.lit(1).alias("_in"))
    per = ranked.select("image_id", "at", "total").join(_fresh(left, taken), ["image_id", "at"], "left").join(now, ["image_id", "at"], "left")
    per = per.fillna(0, ["n", "pos", "_in"]).withColumns({"_n": F.col("n") * F.col("_in"), "_pos": F.col("pos") * F.col("_in")})
    run = running_total(per, ["image_id"], F.floor(F.col("at") / WALK_BLOCK), [F.asc("at")], {"area": "_n", "right": "_pos"})
    run = run.withColumns({"area": F.col("area") - F.col("_n"), "right": F.col("right") - F.col("_pos")})
    iou = lambda hits, area: hits / F.greatest(F.col("total") + area - hits, F.lit(1))
    after = iou(F.col("right") + F.col("pos"), F.col("area") + F.col("n"))
    return run.select("image_id", "at", "_in", after.alias("iou"), (after > iou(F.col("right"), F.col("area"))).alias("_take"))


WALK_BLOCK = 4096  # places of the order that a task sums


def greedy_union(proposals: DataFrame, truth: DataFrame) -> DataFrame:
    """Best of purity-ordered greedy and majority selection: (image_id, proposal, iou).

    Pixels covered by the same set of proposals are one row with their counts.  The walk over the proposals in order of purity is
    solved for all of them at once: each is judged against the taken ones before it, by running sums, and the judgement is repeated
    with what it takes until it takes the same.  A proposal's verdict follows from those before it alone, so there is one such
    outcome, the walk's, and every repetition makes at least one more place of the order final.
    """
    cover = proposals.groupBy(*PIXEL).agg(F.sort_array(F.collect_set("proposal")).alias("sig"))
    t = truth.select(*PIXEL).withColumn("_t", F.lit(True))
    cells = cover.join(t, PIXEL, "full").groupBy("image_id", "sig").agg(F.count(F.lit(1)).alias("n"), F.count("_t").alias("pos"))
    cells = materialize(cells.withColumn("sid", F.monotonically_increasing_id()), "cells")
    member = cells.select("image_id", "sid", "n", "pos", F.explode("sig").alias("proposal"))
    pure = member.groupBy("image_id", "proposal").agg((F.sum("pos") / F.sum("n")).alias("purity"))
    total = cells.groupBy("image_id").agg(F.sum("pos").alias("total"))
    # Ids of rows in a global order rise with it; they leave gaps, which the walk does not mind.
    order = pure.join(total, "image_id").orderBy("image_id", F.desc("purity"), "proposal")
    ranked = materialize(order.withColumn("at", F.monotonically_increasing_id()), "ranked")
    left = materialize(member.join(ranked.select("image_id", "proposal", "at"), ["image_id", "proposal"]).drop("proposal"), "members")
    taken = ranked.filter("purity > 0").select("image_id", "at")
    while True:
        judged = materialize(_walk(ranked, left, taken), "walk")
        if judged.filter("_take != (_in = 1)").isEmpty():
            break
        taken = judged.filter("_take").select("image_id", "at")
    best = ranked.select("image_id").distinct().join(judged.filter("_take").groupBy("image_id").agg(F.max("iou").alias("best")), "image_id", "left").fillna(0.0, ["best"])
    major = left.join(ranked.filter("purity > 0.5").select("image_id", "at"), ["image_id", "at"], "left_semi").select("image_id", "sid", "n", "pos").distinct()
    major = major.groupBy("image_id").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).join(total, "image_id")
    major = major.select("image_id", (F.col("pos") / F.greatest(F.col("total") + F.col("n") - F.col("pos"), F.lit(1))).alias("_m"))
    verdict = best.join(major, "image_id", "left").withColumn("_majority", F.coalesce(F.col("_m") > F.col("best"), F.lit(False)))
    verdict = materialize(verdict.select("image_id", "_majority", F.when(F.col("_majority"), F.col("_m")).otherwise(F.col("best")).alias("iou")), "verdict")
    chosen = taken.join(verdict.filter("NOT _majority"), "image_id").unionByName(ranked.filter("purity > 0.5").select("image_id", "at").join(verdict.filter("_majority"), "image_id"))
    return chosen.join(ranked.select("image_id", "at", "proposal"), ["image_id", "at"]).select("image_id", "proposal", "iou")


def top_boxes(props: DataFrame, k: int = 32, min_area: int = 200) -> DataFrame:
    """Bounding boxes of the k largest regions per frame."""
    w = Window.partitionBy("image_id").orderBy(F.desc("area"), "region_id")
    return props.filter(F.col("area") >= min_area).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).select(
        "image_id", "region_id", "area", "x0", "y0", "x1", "y1")


def sampled_points(px: DataFrame, n: int, seed) -> DataFrame:
    return take_by_hash(px, ["image_id"], hash_order(seed, *PIXEL), n).select(*PIXEL)


def grid_points(frames: DataFrame, n: int = 32, margin: int = 16) -> DataFrame:
    """Uniform n x n prompt grid of every frame."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    at = lambda size, i: F.lit(margin) + F.col(i) * ((F.col(size) - 1 - 2 * margin) / F.lit(float(max(n - 1, 1))))
    g = frames.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return g.select("image_id", at("fh", "_i").alias("y"), at("fw", "_j").alias("x"))
