"""Ternary label layers: archive, restore, import, packing, conflicts and never-clobber writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ["image_id", "y", "x"]


def label_counts(labels: DataFrame, keys=("image_id",)) -> DataFrame:
    """Positive and negative pixels per frame; frames without labels are absent."""
    return labels.groupBy(*keys).agg(
        F.count_if(F.col("state") == 1).alias("n_pos"), F.count_if(F.col("state") == 2).alias("n_neg"))


def merge_snapshot(live: DataFrame, archive: DataFrame, prune: bool = False) -> DataFrame:
    """Live frames win whole; archived frames that are not loaded are carried unless ``prune``."""
    fresh = live.withColumn("origin", F.lit("live"))
    if prune:
        return fresh
    carried = archive.join(live.select("image_id").distinct(), "image_id", "left_anti")
    return fresh.unionByName(carried.withColumn("origin", F.lit("carried")))


def snapshot_manifest(merged: DataFrame) -> DataFrame:
    """Counts per frame, per origin and in total, from one pre-aggregate."""
    per = label_counts(merged, ("origin", "image_id"))
    return per.rollup("origin", "image_id").agg(
        F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), F.count(F.lit(1)).alias("n_images"))


def snapshot_status(live: DataFrame, archive: DataFrame) -> DataFrame:
    """Which frames are only live, changed since saving, only saved, or equal."""
    a, b = label_counts(live).alias("l"), label_counts(archive).alias("s")
    status = (F.when(F.col("s.image_id").isNull(), "only_live").when(F.col("l.image_id").isNull(), "only_saved")
              .when((F.col("l.n_pos") != F.col("s.n_pos")) | (F.col("l.n_neg") != F.col("s.n_neg")), "changed")
              .otherwise("same"))
    j = a.join(b, F.col("l.image_id") == F.col("s.image_id"), "full")
    return j.select(F.coalesce("l.image_id", "s.image_id").alias("image_id"), status.alias("status"))


def restore_plan(archive: DataFrame, live: DataFrame, frames: DataFrame, shapes: DataFrame, force: bool = False) -> DataFrame:
    """What a restore does with every archived frame: absent, kept, shape, or wrote."""
    arch = label_counts(archive).join(shapes, "image_id")
    mine = label_counts(live).select("image_id", (F.col("n_pos") + F.col("n_neg")).alias("n_live"))
    j = arch.join(frames, "image_id", "left").join(mine, "image_id", "left")
    has = F.coalesce(F.col("n_live"), F.lit(0)) > 0
    action = F.when(F.col("height").isNull(), "absent")
    if not force:
        action = action.when(has, "kept")
    action = action.when((F.col("height") != F.col("a_height")) | (F.col("width") != F.col("a_width")), "shape")
    return j.select("image_id", "n_pos", "n_neg", action.otherwise("wrote").alias("action"))


def import_plan(masks: DataFrame, live: DataFrame, frames: DataFrame, shapes: DataFrame, force: bool = False,
                with_positives: bool = False) -> DataFrame:
    """Per offered mask, the reason for skipping it or NULL when it is imported."""
    c = label_counts(masks).join(shapes, "image_id")
    if not with_positives:
        c = c.withColumn("n_pos", F.lit(0).cast("long"))
    mine = label_counts(live).select("image_id", (F.col("n_pos") + F.col("n_neg")).alias("n_live"))
    j = c.join(frames, "image_id", "left").join(mine, "image_id", "left")
    reason = F.when(F.col("height").isNull(), "not loaded").when(
        (F.col("height") != F.col("a_height")) | (F.col("width") != F.col("a_width")), "shape")
    if not force:
        reason = reason.when(F.coalesce(F.col("n_live"), F.lit(0)) > 0, "has labels")
    reason = reason.when(F.col("n_pos") + F.col("n_neg") == 0, "no usable labels")
    return j.select("image_id", "grp", "n_pos", "n_neg", reason.alias("reason"))


def pack_runs(labels: DataFrame) -> DataFrame:
    """Run-length form: one row per horizontal run of equal state."""
    w = Window.partitionBy("image_id", "y").orderBy("x")
    runs = labels.withColumn("_new", F.when(
        (F.col("x") - F.lag("x").over(w) == 1) & (F.col("state") == F.lag("state").over(w)), 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("image_id", "y", "_run", "state").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_run")


def unpack_runs(runs: DataFrame) -> DataFrame:
    return runs.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "state")


def write_where_silent(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Never-clobber append: new labels only where no opinion is stored."""
    return existing.select(*PIXEL, "state").unionByName(
        new.select(*PIXEL, "state").join(existing.select(*PIXEL), PIXEL, "left_anti"))


def clear_conflicts(labels: DataFrame, truth: DataFrame, both_sides: bool = False) -> DataFrame:
    """Labels without those the truth contradicts; contradicted ones are dropped, not flipped."""
    return labels.join(conflicts(labels, truth, both_sides).select(*PIXEL), PIXEL, "left_anti")


def conflicts(labels: DataFrame, truth: DataFrame, both_sides: bool = False) -> DataFrame:
    j = labels.join(truth.select(*PIXEL, "is_pos"), PIXEL)
    bad = (F.col("state") == 2) & F.col("is_pos")
    if both_sides:
        bad = bad | ((F.col("state") == 1) & ~F.col("is_pos"))
    return j.filter(bad)


def confirm_clean(labels: DataFrame, clean: DataFrame, interior: DataFrame) -> DataFrame:
    """Frames confirmed to be empty: positives go, the whole interior becomes negative."""
    rest = labels.join(clean.select("image_id"), "image_id", "left_anti")
    inside = interior.join(clean.select("image_id"), "image_id", "left_semi").select(*PIXEL)
    old = labels.filter("state = 2").join(clean.select("image_id"), "image_id", "left_semi").select(*PIXEL)
    return rest.select(*PIXEL, "state").unionByName(inside.union(old).distinct().withColumn("state", F.lit(2)))


def coverage_band(fraction: Column) -> Column:
    """Judged-fraction band of a frame."""
    return (F.when(fraction >= 0.95, "dense").when(fraction < 0.01, "untouched").otherwise("partial"))


def markup_state(n_pos: Column, n_neg: Column) -> Column:
    return F.when(n_pos > 0, "HAND_MARKED").when(n_neg > 0, "NEG_ONLY").otherwise("UNTOUCHED")


def fragment_match(fragments: DataFrame, names: DataFrame, gram: int = 3) -> DataFrame:
    """First frame, by id, whose name contains each fragment, ignoring case.

    ``contains`` alone would force a nested-loop join.  Names are counted by their short character grams, each fragment
    meets them by its rarest one, and the full containment is then verified.  So fragments with a common
    beginning don't share a key, and one with a gram that no name has meets none.  Frames of one name are one row throughout.
    """
    cuts = lambda c, sizes: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(
        sizes, lambda k: F.substring(F.col(c), i, k)))))
    frag = fragments.select("fragment", F.lower("fragment").alias("_f")).filter("_f <> ''").distinct()
    low = names.groupBy(F.lower("name").alias("_n")).agg(F.min("image_id").alias("image_id"), F.count(F.lit(1)).alias("_frames")).filter("_n <> ''")
    indexed = low.select("image_id", "_frames", "_n", F.explode(cuts("_n", F.sequence(F.lit(1), F.lit(gram)))).alias("_g"))
    own = frag.select("fragment", "_f", F.explode(cuts("_f", F.array(F.least(F.lit(gram), F.length("_f"))))).alias("_g"))
    own = own.filter(F.length("_g") == F.least(F.lit(gram), F.length("_f")))
    held = indexed.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"))
    rarest = own.join(held, "_g", "left").groupBy("fragment", "_f").agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("_c"), "_g")).alias("_k"))
    hits = rarest.select("fragment", "_f", F.col("_k._g").alias("_g")).join(indexed, "_g").filter(F.col("_n").contains(F.col("_f")))
    return hits.groupBy("fragment").agg(F.min("image_id").alias("image_id"), F.sum("_frames").alias("n_matches"))
