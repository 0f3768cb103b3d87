"""Region measurement and region-level filters over labelled runs.

Input is the table of ``components.label_runs``.  All sums are taken per run in closed
form, relative to the region's first pixel, so no mask is expanded to pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators import runs as R
from rasterloom.operators.components import label_runs
from rasterloom.operators.ordered import running_total
from rasterloom.sources.tables import PACK

KEY = ["image_id", "region_id"]


def origin() -> tuple[Column, Column]:
    """Row and column of the region's first pixel."""
    return F.expr(f"region_id div {PACK}"), F.col("region_id") % PACK


def run_length() -> Column:
    return F.col("x1") - F.col("x0") + 1


def areas(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(*KEY).agg(F.sum(run_length()).alias("area"))


def region_props(labelled: DataFrame) -> DataFrame:
    """Area, bounding box (half open), centroid, axes, eccentricity, orientation and extent per region."""
    n = run_length().cast("double")
    oy, ox = origin()
    a, b = (F.col("x0") - ox).cast("double"), (F.col("x1") - ox).cast("double")
    dy = (F.col("y") - oy).cast("double")
    sum_x, sum_xx = (a + b) * n / 2, (b * (b + 1) * (2 * b + 1) - (a - 1) * a * (2 * a - 1)) / 6
    s = labelled.groupBy(*KEY).agg(
        F.sum(run_length()).alias("area"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x0").alias("bx0"),
        (F.max("x1") + 1).alias("bx1"), F.sum(dy * n).alias("_sy"), F.sum(sum_x).alias("_sx"), F.sum(dy * dy * n).alias("_syy"),
        F.sum(sum_xx).alias("_sxx"), F.sum(dy * sum_x).alias("_sxy"), F.first("fh").alias("fh"), F.first("fw").alias("fw"))
    m = F.col("area")
    my, mx = F.col("_sy") / m, F.col("_sx") / m
    vy, vx, cov = F.col("_syy") / m - my * my, F.col("_sxx") / m - mx * mx, F.col("_sxy") / m - my * mx
    s = s.withColumns({"cy": my + oy, "cx": mx + ox, "_vy": F.round(vy, 10), "_vx": F.round(vx, 10), "_cov": F.round(cov, 10)})
    mean, half = (F.col("_vy") + F.col("_vx")) / 2, (F.col("_vy") - F.col("_vx")) / 2
    disc = F.sqrt(half * half + F.col("_cov") * F.col("_cov"))
    s = s.withColumns({"_l1": mean + disc, "_l2": F.greatest(mean - disc, F.lit(0.0))})
    flat = F.col("_vy") == F.col("_vx")
    orient = F.when(flat, F.when(F.col("_cov") > 0, F.pi() / 4).otherwise(-F.pi() / 4)).otherwise(
        F.atan2(2 * F.col("_cov"), F.col("_vy") - F.col("_vx")) / 2)
    return s.select(
        *KEY, "fh", "fw", "area", "y0", "y1", F.col("bx0").alias("x0"), F.col("bx1").alias("x1"), "cy", "cx",
        (4 * F.sqrt("_l1")).alias("major"), (4 * F.sqrt("_l2")).alias("minor"),
        F.when(F.col("_l1") > 0, F.sqrt(F.lit(1.0) - F.col("_l2") / F.col("_l1"))).otherwise(0.0).alias("ecc"),
        orient.alias("orientation"),
        (m / ((F.col("y1") - F.col("y0")) * (F.col("bx1") - F.col("bx0")))).alias("extent"))


def euler_numbers(labelled: DataFrame) -> DataFrame:
    """Components minus holes of every 8-connected region: runs minus touching pairs of runs in adjacent rows."""
    a = labelled.select(*KEY, (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    pairs = a.join(labelled.select(*KEY, "y", "x0", "x1"), KEY + ["y"]).filter("x0 <= a1 + 1 AND x1 >= a0 - 1")
    links = pairs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_e"))
    nodes = labelled.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_v"))
    return nodes.join(links, KEY, "left").select(*KEY, (F.col("_v") - F.coalesce("_e", F.lit(0))).alias("euler"))


def border_pixels(labelled: DataFrame) -> DataFrame:
    """Pixels of a region with a 4-neighbour outside it; the frame edge counts as outside.

    Only the runs of edge pixels are expanded; each lies in the labelled run that starts last before it.
    """
    inner = R.erode(labelled.select(*R.RUN), R.cross(), outside=False)
    edge = R.subtract(labelled.select(*R.RUN), inner)
    starts = labelled.select("image_id", "y", "x0", F.lit(None).cast("int").alias("x1"), "region_id").unionByName(
        edge.select("image_id", "y", "x0", "x1", F.lit(None).cast("bigint").alias("region_id")))
    w = Window.partitionBy("image_id", "y").orderBy("x0", F.col("x1").asc_nulls_first())
    own = starts.withColumn("region_id", F.last("region_id", ignorenulls=True).over(w)).filter("x1 IS NOT NULL")
    return R.to_pixels(own, "region_id")


def border_lengths(b: DataFrame) -> DataFrame:
    """Length of every region's border pixels, weighted by how their border neighbours lie."""
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(10 if dy and dx else 2 if dy or dx else 1).alias("w"))
                       for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    cast = b.withColumn("_o", F.explode(around)).select(
        *KEY, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"), F.col("_o.w").alias("w"))
    code = cast.groupBy(*KEY, "y", "x").agg(F.sum("w").alias("code"), F.min("w").alias("_own")).filter("_own = 1")
    r2 = 2 ** 0.5
    # Contribution of each neighbour code to the length.
    length = (F.when(F.col("code").isin(5, 7, 15, 17, 25, 27), 1.0).when(F.col("code").isin(21, 33), r2)
              .when(F.col("code").isin(13, 23), (1 + r2) / 2).otherwise(0.0))
    return code.groupBy(*KEY).agg(F.sum(length).alias("length"))


def perimeters(labelled: DataFrame) -> DataFrame:
    """Crofton-style perimeter of every region."""
    return areas(labelled).join(border_lengths(border_pixels(labelled)), KEY, "left").select(*KEY, "area", F.coalesce("length", F.lit(0.0)).alias("perimeter"))


def circularity(area: Column, perimeter: Column) -> Column:
    p = F.when(perimeter > 0, perimeter).otherwise(1.0)
    return F.least(F.lit(1.0), 4 * F.pi() * area / (p * p))


def keep_regions(labelled: DataFrame, kept: DataFrame) -> DataFrame:
    return labelled.join(kept.select(*KEY), KEY, "left_semi")


def remove_small(runs: DataFrame, min_area: int, connectivity: int, **opts) -> DataFrame:
    """Mask without regions below ``min_area`` pixels."""
    lab = label_runs(runs, connectivity, **opts)
    return keep_regions(lab, areas(lab).filter(F.col("area") >= min_area)).select(*R.RUN)


def border_touching(labelled: DataFrame, min_fraction: float, strict: bool = True) -> DataFrame:
    """Regions that meet the frame edge and exceed a fraction of the frame."""
    edge = (F.col("y") == 0) | (F.col("y") == F.col("fh") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("fw") - 1)
    s = labelled.groupBy(*KEY).agg(F.sum(run_length()).alias("area"), F.bool_or(edge).alias("_edge"), F.first("fh").alias("fh"), F.first("fw").alias("fw"))
    limit = F.lit(min_fraction) * F.col("fh") * F.col("fw")
    big = F.col("area") > limit if strict else F.col("area") >= limit
    return s.filter(F.col("_edge") & big).select(*KEY, "area")


def largest(labelled: DataFrame) -> DataFrame:
    """Largest region per frame (first in scan order on a tie), with its share of all region area."""
    a = areas(labelled)
    return a.groupBy("image_id").agg(
        F.max_by("region_id", F.struct(F.col("area"), -F.col("region_id"))).alias("region_id"), F.max("area").alias("area"),
        (F.max("area") / F.sum("area")).alias("dominance"))


def shape_filter(labelled: DataFrame, hole_max: int = 800, round_max: int = 5000, ecc_min: float = 0.5) -> DataFrame:
    """Regions kept after dropping small holed ones and small round ones."""
    p = region_props(labelled).select(*KEY, "area", "ecc").join(euler_numbers(labelled), KEY)
    holed = (F.col("area") < hole_max) & (F.col("euler") < 1)
    round_ = (F.col("area") <= round_max) & (F.col("ecc") < ecc_min)
    return keep_regions(labelled, p.filter(~holed & ~round_))


def grow_into(kept: DataFrame, weak: DataFrame, radius: int = 3) -> DataFrame:
    """Kept mask plus weak pixels within ``radius`` of it."""
    return R.union(kept, R.intersect(R.dilate(kept, R.disk(radius)), weak))


def fill_holes(runs: DataFrame, max_area: int | None = None, **opts) -> DataFrame:
    """Fill 4-connected background regions that are small enough, or all that miss the frame edge."""
    frames = runs.select("image_id", "fh", "fw").distinct()
    lab = label_runs(R.complement(runs, frames), 4, **opts)
    if max_area is None:
        edge = (F.col("y") == 0) | (F.col("y") == F.col("fh") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("fw") - 1)
        holes = lab.groupBy(*KEY).agg(F.bool_or(edge).alias("_open")).filter("NOT _open")
    else:
        holes = areas(lab).filter(F.col("area") <= max_area)
    return R.union(runs, keep_regions(lab, holes).select(*R.RUN))


def relabel_dense(labelled: DataFrame, min_area: int) -> DataFrame:
    """Labels 1..N in scan order for the regions that survive the size filter."""
    kept = areas(labelled).filter(F.col("area") >= min_area).withColumn("_one", F.lit(1))
    return running_total(kept, ["image_id"], F.floor(F.col("region_id") / (PACK * 4096)), [F.asc("region_id")],
                         {"label": "_one"}).select(*KEY, "area", "label")


def hits(labelled: DataFrame, mask: DataFrame) -> DataFrame:
    """Area and detection flag of every region: found if any of its pixels is in the mask."""
    m = mask.select("image_id", "y", F.col("x0").alias("m0"), F.col("x1").alias("m1"))
    touched = labelled.join(m, ["image_id", "y"]).filter("m0 <= x1 AND m1 >= x0").select(*KEY).distinct()
    return areas(labelled).join(touched.withColumn("_hit", F.lit(True)), KEY, "left").withColumn(
        "hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def size_bin(area: Column, edges: Sequence[int]) -> Column:
    """Half-open bins: index of the first edge above the area."""
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(area < edges[i], F.lit(i)).otherwise(out)
    return out


def detection_probability(labelled: DataFrame, mask: DataFrame, edges: Sequence[int]) -> DataFrame:
    h = hits(labelled, mask).groupBy(size_bin(F.col("area"), edges).alias("bin")).agg(
        F.count_if("hit").alias("found"), F.count(F.lit(1)).alias("total"), F.sum("area").alias("pixels"))
    whole = h.agg(F.sum("pixels")).scalar()
    return h.withColumns({"rate": F.col("found") / F.col("total"), "pixel_share": F.col("pixels") / whole})


def spontaneous(candidate: DataFrame, production: DataFrame, frames: DataFrame, limit: float = 0.02) -> DataFrame:
    """Area of candidate regions without any production pixel, per frame."""
    h = hits(label_runs(candidate, 8), production)
    new = h.groupBy("image_id").agg(F.sum(F.when(~F.col("hit"), F.col("area")).otherwise(0)).alias("new_area"))
    j = frames.join(new, "image_id", "left").withColumn("new_area", F.coalesce("new_area", F.lit(0)))
    fraction = F.col("new_area") / (F.col("fh") * F.col("fw"))
    return j.select("image_id", "new_area", fraction.alias("fraction"), (fraction > limit).alias("flagged"))


def false_indications(prob_mask: DataFrame, frames: DataFrame, min_area: int, **opts) -> DataFrame:
    """Regions (8-connected) of the pruned (4-connected) mask and its area fraction, per frame."""
    lab = label_runs(remove_small(prob_mask, min_area, 4, **opts), 8, **opts)
    per = lab.groupBy("image_id").agg(F.countDistinct("region_id").alias("indications"), F.sum(run_length()).alias("_a"))
    j = frames.join(per, "image_id", "left")
    return j.select("image_id", F.coalesce("indications", F.lit(0)).alias("indications"),
                    F.round(F.coalesce("_a", F.lit(0)) / (F.col("fh") * F.col("fw")), 6).alias("area_fraction"))


def false_indication_summary(per_frame: DataFrame) -> DataFrame:
    """One row over clean frames: frames, mean and worst of both measures, and frames without any indication."""
    return per_frame.agg(
        F.count(F.lit(1)).alias("n_frames"), F.avg("area_fraction").alias("mean_area"), F.max("area_fraction").alias("max_area"),
        F.avg("indications").alias("mean_indications"), F.max("indications").alias("max_indications"), F.count_if(F.col("indications") == 0).alias("n_clear"))


def phase_reject(labelled: DataFrame, props: DataFrame, pitch: DataFrame, min_area: int, bins: int = 8, excess: float = 2.5,
                 keep_ecc: float = 0.9, min_regions: int = 12) -> DataFrame:
    """Regions locked to one phase of the tile pitch; frames with few regions are left alone."""
    r = props.filter(F.col("area") >= min_area).join(pitch, "image_id")
    cell = lambda c, p: F.floor((F.col(c) % F.col(p)) / F.col(p) * bins)
    r = r.withColumns({"_by": cell("cy", "pitch_y"), "_bx": cell("cx", "pitch_x")})
    cells = r.groupBy("image_id", "_by", "_bx").agg(F.count(F.lit(1)).alias("_c"))
    total = cells.groupBy("image_id").agg(F.sum("_c").alias("_n"))
    hot = cells.join(total, "image_id").filter(
        (F.col("_n") >= min_regions) & (F.col("_c") > F.col("_n") / float(bins * bins) * excess)).select("image_id", "_by", "_bx")
    return r.join(hot, ["image_id", "_by", "_bx"], "left_semi").filter(F.col("ecc") < keep_ecc).select(*KEY)
