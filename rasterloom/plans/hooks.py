"""Queries through the user hooks."""

from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.operators import fragments as M
from rasterloom.operators import hooks as U
from rasterloom.operators import regions as G
from rasterloom.plans.regions import lab, labelled
from rasterloom.plans.registry import query
from rasterloom.sources import tables as T


def threshold_arm(scores, column, threshold):
    hit = F.col(column) > threshold
    return scores.agg(S.r6(F.count_if(hit & F.col("is_pos")) / F.count_if(hit | F.col("is_pos"))).alias("iou"))


ARMS = {"a_low": ("pa", 0.4, True), "a_mid": ("pa", 0.5, True), "b_mid": ("pb", 0.5, False)}


@query("u03_conditions", "scores", " UNION ALL ".join(
    f"SELECT '{n}' AS condition, {str(d).lower()} AS deployable, round(count(*) FILTER ({c} > {t} AND is_pos) / count(*) FILTER ({c} > {t} OR is_pos), 6) AS iou FROM scores"
    for n, (c, t, d) in ARMS.items()))
def conditions(spark, root):
    arms = {n: U.Condition(threshold_arm, {"column": c, "threshold": t}, d) for n, (c, t, d) in ARMS.items()}
    return U.run_conditions(arms, T.scores(spark, root))


def mean_pool(stack):
    """Stand-in encoder: the mean of each 4x4 cell, one channel."""
    n, h, w = stack.shape
    return stack.reshape(n, 1, h // 4, 4, w // 4, 4).mean(axis=(3, 5))


@query("u04_tile_encoder", "px8", """SELECT image_id, (y // 4)::INT AS gy, (x // 4)::INT AS gx, round(avg(v), 6) + 0.0 AS v FROM px8 GROUP BY ALL""")
def tile_encoder(spark, root):
    tiles = T.px8_tiles(spark, root).withColumn("image_id", F.col("image_id").cast("long"))
    e = U.embed_tiles(tiles, mean_pool, 1)
    cells = e.select("image_id", F.col("gx").alias("_w"), F.posexplode("e").alias("_i", "v"))
    return cells.select("image_id", F.floor(F.col("_i") / F.col("_w")).cast("int").alias("gy"), (F.col("_i") % F.col("_w")).cast("int").alias("gx"), S.r6("v").alias("v"))


@query("e10_nearest_region", "grid", lab("l", "grid", "p > 0.5", 8) + """, a AS (SELECT image_id, region_id FROM l GROUP BY 1, 2 HAVING count(*) >= 4),
    k AS (SELECT l.* FROM l SEMI JOIN a USING (image_id, region_id)),
    d AS (SELECT p.image_id, p.region_id AS u, q.region_id AS v, min((p.y - q.y) ** 2 + (p.x - q.x) ** 2) AS d2 FROM k p JOIN k q ON p.image_id = q.image_id
    AND p.region_id <> q.region_id AND abs(p.y - q.y) <= 12 AND abs(p.x - q.x) <= 12 GROUP BY 1, 2, 3)
    SELECT image_id, u AS region_id, arg_min(v, (d2, v)) AS nearest, round(sqrt(min(d2)), 6) AS gap FROM d WHERE d2 <= 144 GROUP BY 1, 2""")
def nearest_region(spark, root):
    """Nearest other region within the gap, by pixel distance."""
    lb = labelled(spark, root, "p > 0.5")
    pairs = M.near_pairs(G.keep_regions(lb, G.areas(lb).filter("area >= 4")), 12).select("image_id", "u", "v", "gap")
    both = pairs.union(pairs.select("image_id", F.col("v").alias("u"), F.col("u").alias("v"), "gap"))
    return both.groupBy("image_id", F.col("u").alias("region_id")).agg(F.min_by("v", F.struct("gap", "v")).alias("nearest"), S.r6(F.min("gap")).alias("gap"))
