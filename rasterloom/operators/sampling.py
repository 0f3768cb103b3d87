"""Deterministic sampling by seeded md5 order.

A rank over a whole frame or class would sort one hot group in one task.  Here the
digest prefix splits every group into 4096 even buckets: buckets past the cap are dropped
before any shuffle, and the rest are ranked bucket by bucket, so no group meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.ordered import running_total


def hash_order(seed: str | int, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def take_by_hash(df: DataFrame, keys: Sequence[str], order: Column, cap: Column | int, rank: str | None = None) -> DataFrame:
    """First ``cap`` rows of every group in digest order, exactly; groups below the cap stay whole.

    ``cap`` may be a column that is constant within a group.  ``rank`` names a column for a row's place in its group, from 1, so
    that samples of several sizes are cut from one.
    """
    keys = list(keys)
    whole = not keys
    if whole:
        keys = ["_all"]
        df = df.withColumn("_all", F.lit(0))
    cap = F.lit(cap) if isinstance(cap, int) else cap
    hashed = df.withColumn("_h", order).withColumn("_b", F.substring("_h", 1, 3))
    hashed = hashed.withColumn("_cap", cap.cast("long"))
    counts = hashed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"), F.first("_cap").alias("_cap"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_end", F.sum("_c").over(upto))
    cut = (
        counts.filter("_end > _cap AND _end - _c <= _cap")
        .groupBy(*keys).agg(F.min("_b").alias("_cut"), F.max(F.col("_cap") - (F.col("_end") - F.col("_c"))).alias("_rest"))
    )
    # Joined by bucket as well, so that a hot group's rows stay spread and rows past the cut drop in the join.
    within = counts.join(cut, keys, "left").filter("_cut IS NULL OR _b <= _cut").select(*keys, "_b", "_cut", "_rest", (F.col("_end") - F.col("_c")).alias("_before"))
    # Without keys there is a row per digest prefix, 4096 at most; broadcast, so that rows past the cut are not shuffled first.
    kept = hashed.join(F.broadcast(within) if whole else within, [*keys, "_b"])
    kept = kept.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h")))
    kept = kept.filter("_cut IS NULL OR _b < _cut OR _rn <= _rest")
    if rank:
        kept = kept.withColumn(rank, F.col("_before") + F.col("_rn"))
    out = kept.drop("_h", "_b", "_cap", "_cut", "_rest", "_before", "_rn")
    return out.drop("_all") if whole else out


def uniform_pixels(df: DataFrame, n: int, seed: str | int, ident: Sequence[str], frame: str = "image_id") -> DataFrame:
    """``n`` uniform pixels of every frame."""
    return take_by_hash(df, [frame], hash_order(seed, *ident), n)


def stratified_cap(
    df: DataFrame, cap: Column | int, seed: str | int, ident: Sequence[str], frame: str = "image_id", label: str = "label"
) -> DataFrame:
    """At most ``cap`` rows per (frame, class)."""
    return take_by_hash(df, [frame, label], hash_order(seed, *ident), cap)


def balanced_negative_cap(counts: DataFrame, per_frame: int = 30000, floor: int = 500) -> DataFrame:
    """One row: the negative cap that balances positives capped at ``per_frame`` over frames with negatives.

    ``counts`` has one row per frame with ``n_pos`` and ``n_neg``.
    """
    total = F.sum(F.least(F.col("n_pos"), F.lit(per_frame)))
    frames = F.count_if(F.col("n_neg") > 0)
    return counts.agg(
        F.when(frames > 0, F.greatest(F.lit(floor), F.rint(total / frames).cast("long")))
        .otherwise(F.lit(per_frame)).cast("long").alias("neg_cap"))


def class_weights(df: DataFrame, label: str = "label", source_weight: Column | None = None) -> DataFrame:
    """``n / (2 n_class)`` times the weight of the row's source."""
    total = F.sum("_c").over(Window.partitionBy())
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c")).withColumn("_w", total / (2.0 * F.col("_c")))
    weight = F.col("_w") * (source_weight if source_weight is not None else F.lit(1.0))
    return df.join(per_class.select(label, "_w"), label).withColumn("weight", weight).drop("_w")


def tile_allotment(df: DataFrame, n: int, seed: str | int, ident: Sequence[str], tile: int = 1024, label: str = "label") -> DataFrame:
    """``n`` pixels per class spread evenly over the occupied tiles of each frame."""
    tiled = df.withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))
    n_tiles = tiled.groupBy("image_id").agg(F.countDistinct("ty", "tx").alias("_tiles"))
    capped = tiled.join(n_tiles, "image_id").withColumn("_share", F.greatest(F.floor(F.lit(n) / F.col("_tiles")), F.lit(1)))
    return take_by_hash(capped, ["image_id", "ty", "tx", label], hash_order(seed, *ident), F.col("_share")).drop("_tiles", "_share")


def candidate_corners(frames: DataFrame, want: int, tile: int, seed: str | int, tries_per_tile: int = 200) -> DataFrame:
    """``want * tries_per_tile`` hashed tile corners per frame that is at least one tile large."""
    def draw(axis: str, size: str) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(axis), F.col("image_id").cast("string"), F.col("try").cast("string")))
        room = F.greatest(F.col(size) - tile, F.lit(1))
        return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % room).cast("int")

    fits = frames.filter((F.col("height") >= tile) & (F.col("width") >= tile))
    tries = fits.withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(want * tries_per_tile))))
    return tries.select("image_id", "try", draw("y", "height").alias("y"), draw("x", "width").alias("x"))


def covered_corners(cand: DataFrame, support: DataFrame, tile: int, min_on: float) -> DataFrame:
    """Candidates with at least ``min_on`` of their pixels on the support, and how many.

    Support pixels are counted per row between the columns where some candidate of the frame begins or ends; a candidate
    adds up the counts of its rows, so no pixel meets a candidate.
    """
    ends = cand.select("image_id", F.explode(F.array("x", F.col("x") + tile)).alias("edge")).distinct()
    edges = ends.groupBy("image_id").agg(F.sort_array(F.collect_list("edge")).alias("edges"))  # two per candidate of a frame at most
    slot = F.size(F.filter("edges", lambda e: e <= F.col("x")))
    per = support.select("image_id", "y", "x").join(edges, "image_id").groupBy("image_id", "y", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    lines = per.groupBy("image_id", F.col("y").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("held"))
    rows = cand.join(edges, "image_id").select(
        "image_id", "try", "y", "x", F.array_position("edges", F.col("x")).cast("int").alias("a"), F.array_position("edges", F.col("x") + tile).cast("int").alias("b"),
        F.explode(F.sequence(F.col("y"), F.col("y") + tile - 1)).alias("row"))
    inside = F.aggregate(F.sequence(F.col("a"), F.col("b") - 1), F.lit(0).cast("bigint"), lambda s, i: s + F.coalesce(F.try_element_at("held", i), F.lit(0).cast("bigint")))
    return rows.join(lines, ["image_id", "row"]).groupBy("image_id", "try", "y", "x").agg(F.sum(inside).alias("n_on")).filter(F.col("n_on") >= min_on * tile * tile)


def sample_tiles(frames: DataFrame, support: DataFrame, want: int, tile: int, seed: str | int, min_on: float = 0.9,
                 tries_per_tile: int = 200) -> DataFrame:
    """Up to ``want`` tiles per frame, at least ``min_on`` on the specimen and never within half a tile.

    The greedy pass sees at most ``want * tries_per_tile`` candidates of a frame.
    """
    covered = covered_corners(candidate_corners(frames, want, tile, seed, tries_per_tile), support, tile, min_on)

    def pick(pdf):
        pdf = pdf.sort_values("try")
        ys, xs, keep = [], [], []
        for i, (y, x) in enumerate(zip(pdf["y"].to_numpy(), pdf["x"].to_numpy())):
            if len(keep) == want:
                break
            if all(abs(y - a) >= tile // 2 or abs(x - b) >= tile // 2 for a, b in zip(ys, xs)):
                ys.append(y)
                xs.append(x)
                keep.append(i)
        return pdf.iloc[keep]

    return covered.groupBy("image_id").applyInPandas(pick, covered.schema)


def grouped_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Fold of every group, so that rows of one group never split.

    Groups in falling order of size (ties by digest) are dealt to and fro over the folds: 0 .. k-1, k-1 .. 0, and
    so on.  Ranks come from counts by size and digest prefix, so no task orders all groups.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("_h", F.md5(F.col(group).cast("string").cast("binary")))
    sizes = sizes.withColumn("_b", F.substring("_h", 1, 3)).withColumn("_one", F.lit(1))
    ranked = running_total(sizes, [], F.struct((-F.col("n")).alias("n"), F.col("_b").alias("b")), [F.desc("n"), F.asc("_h")], {"_rank": "_one"})
    turn = (F.col("_rank") - 1) % (2 * k)
    return ranked.select(group, "n", F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))
