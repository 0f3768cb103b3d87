"""Sampling, weighting and fold-map queries."""

from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.operators import labels as L
from rasterloom.operators import sampling as K
from rasterloom.plans.registry import query
from rasterloom.sources import tables as T


@query("k01_uniform_pixels", "rows", """SELECT row_key FROM (SELECT row_key, row_number() OVER (PARTITION BY image_id
    ORDER BY md5(concat_ws(':', '0', row_key))) AS rn FROM rows_) WHERE rn <= 100""")
def uniform_pixels(spark, root):
    return K.uniform_pixels(T.rows(spark, root), 100, 0, ["row_key"]).select("row_key")


@query("k02_stratified_cap", "rows", """SELECT row_key, image_id, label FROM (SELECT *, row_number() OVER
    (PARTITION BY image_id, label ORDER BY md5(concat_ws(':', '7', row_key))) AS rn FROM rows_) WHERE rn <= 50""")
def stratified_cap(spark, root):
    return K.stratified_cap(T.rows(spark, root), 50, 7, ["row_key"]).select("row_key", "image_id", "label")


NEG_CAP = """, c AS (SELECT image_id, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM rows_ GROUP BY 1),
    cap AS (SELECT CAST(greatest(60, round_even(sum(least(p, 150)) / count(*) FILTER (n > 0), 0)) AS BIGINT) AS neg_cap FROM c)"""


def neg_cap(rows):
    counts = rows.groupBy("image_id").agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"))
    return K.balanced_negative_cap(counts, per_frame=150, floor=60)


@query("k03_balanced_negative_cap", "rows", NEG_CAP + "SELECT neg_cap FROM cap")
def balanced_negative_cap(spark, root):
    return neg_cap(T.rows(spark, root))


@query("k03_balanced_sample", "rows", NEG_CAP + """, r AS (SELECT *, row_number() OVER (PARTITION BY image_id, label
    ORDER BY md5(concat_ws(':', 'bal', row_key))) AS rn FROM rows_)
    SELECT image_id, label, count(*) AS n_rows FROM r WHERE rn <= CASE WHEN label = 1 THEN 150 ELSE (SELECT neg_cap FROM cap) END
    GROUP BY 1, 2""")
def balanced_sample(spark, root):
    rows = T.rows(spark, root)
    cap = F.when(F.col("label") == 1, F.lit(150)).otherwise(neg_cap(rows).scalar())
    taken = K.stratified_cap(rows.withColumn("cap", cap), F.col("cap"), "bal", ["row_key"])
    return taken.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n_rows"))


@query("k04_global_cap", "rows", """SELECT row_key FROM rows_ ORDER BY md5(concat_ws(':', 'cap', row_key)) LIMIT 9000""")
def global_cap(spark, root):
    return K.take_by_hash(T.rows(spark, root), [], K.hash_order("cap", "row_key"), 9000).select("row_key")


@query("k05_candidate_coverage", "grid", """, f AS (SELECT image_id, max(y) + 1 AS height FROM grid GROUP BY 1),
    d AS (SELECT image_id, height, t AS "try", CAST('0x' || substr(md5(concat_ws(':', '17', 'y', image_id, t)), 1, 8) AS BIGINT) AS hy,
    CAST('0x' || substr(md5(concat_ws(':', '17', 'x', image_id, t)), 1, 8) AS BIGINT) AS hx FROM f, range(1, 801) r(t) WHERE height >= 6),
    c AS (SELECT image_id, "try", hy % greatest(height - 6, 1) AS y, hx % 24 AS x FROM d)
    SELECT c.image_id, "try", c.y::INT AS y, c.x::INT AS x, count(*) AS n_on FROM c JOIN grid g ON g.image_id = c.image_id AND g.y BETWEEN c.y AND c.y + 5
    AND g.x BETWEEN c.x AND c.x + 5 GROUP BY ALL HAVING count(*) >= 0.4 * 36""")
def candidate_coverage(spark, root):
    g = T.grid(spark, root)
    frames = g.groupBy("image_id").agg((F.max("y") + 1).alias("height")).withColumn("width", F.lit(T.GRID_WIDTH))
    return K.covered_corners(K.candidate_corners(frames, 4, 6, 17), g, 6, 0.4)


@query("k05_rejection_tiles")
def rejection_tiles(spark, root):
    g = T.grid(spark, root)
    frames = g.groupBy("image_id").agg((F.max("y") + 1).alias("height")).withColumn("width", F.lit(T.GRID_WIDTH))
    return K.sample_tiles(frames, g, want=4, tile=6, seed=17, min_on=0.4)


@query("k06_tile_allotment", "grid", """, t AS (SELECT *, y // 16 AS ty, x // 16 AS tx, p > 0.5 AS label FROM grid),
    n AS (SELECT image_id, count(DISTINCT (ty, tx)) AS tiles FROM t GROUP BY 1),
    r AS (SELECT t.*, greatest(100 // tiles, 1) AS cap, row_number() OVER (PARTITION BY t.image_id, ty, tx, label
    ORDER BY md5(concat_ws(':', '3', t.image_id, y, x))) AS rn FROM t JOIN n USING (image_id))
    SELECT image_id, y, x FROM r WHERE rn <= cap""")
def tile_allotment(spark, root):
    g = T.grid(spark, root).withColumn("label", F.col("p") > 0.5)
    return K.tile_allotment(g, 100, 3, ["image_id", "y", "x"], tile=16).select("image_id", "y", "x")


@query("k07_class_weights", "rows", """, c AS (SELECT label, count(*) AS n FROM rows_ GROUP BY 1), t AS (SELECT count(*) AS n FROM rows_)
    SELECT label, count(*) AS n_rows, round(sum(t.n / (2.0 * c.n) * CASE WHEN f3 > 0.05 THEN 3.0 ELSE 1.0 END), 4) AS total_weight
    FROM rows_ JOIN c USING (label), t GROUP BY 1""")
def class_weights(spark, root):
    source = F.when(F.col("f3") > 0.05, 3.0).otherwise(1.0)
    w = K.class_weights(T.rows(spark, root), source_weight=source)
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("weight"), 4).alias("total_weight"))


@query("l10_grouped_folds", "rows", """, s AS (SELECT image_id, count(*) AS n FROM rows_ GROUP BY 1),
    t AS (SELECT *, (row_number() OVER (ORDER BY n DESC, md5(image_id::VARCHAR)) - 1) % 10 AS t FROM s)
    SELECT image_id, n, CASE WHEN t < 5 THEN t ELSE 9 - t END::INT AS fold FROM t""")
def grouped_folds(spark, root):
    return K.grouped_folds(T.rows(spark, root), "image_id", 5)


@query("l11_leave_one_image_out_folds", "rows", """, f AS (SELECT image_id, count(*) AS n_test, count(*) FILTER (label = 1) AS n_pos
    FROM rows_ GROUP BY 1), t AS (SELECT count(*) AS n FROM rows_)
    SELECT image_id, n_test, n - n_test AS n_train, n_pos FROM f, t""")
def leave_one_image_out_folds(spark, root):
    per = T.rows(spark, root).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("label") == 1).alias("n_pos"))
    total = per.select(F.sum("n_test")).scalar()
    return per.select("image_id", "n_test", (total - F.col("n_test")).alias("n_train"), "n_pos")


@query("l12_leave_one_group_out_folds", "scores", """, f AS (SELECT lang, count(*) AS n_test, count(DISTINCT image_id) AS n_images
    FROM scores GROUP BY 1), t AS (SELECT count(*) AS n FROM scores) SELECT lang, n_test, n - n_test AS n_train, n_images FROM f, t""")
def leave_one_group_out_folds(spark, root):
    per = T.scores(spark, root).groupBy("lang").agg(F.count(F.lit(1)).alias("n_test"), F.countDistinct("image_id").alias("n_images"))
    total = per.select(F.sum("n_test")).scalar()
    return per.select("lang", "n_test", (total - F.col("n_test")).alias("n_train"), "n_images")


def assemble(rows_ref, rows_fix, ref_cap, fix_cap, fix_weight):
    """Reference rows and corrections, each capped per frame and class, with their own weights."""
    a = K.stratified_cap(rows_ref, ref_cap, "ref", ["row_key"]).withColumn("source_weight", F.lit(1.0))
    b = K.stratified_cap(rows_fix, fix_cap, "fix", ["row_key"]).withColumn("source_weight", F.lit(float(fix_weight)))
    return K.class_weights(a.unionByName(b), source_weight=F.col("source_weight"))


@query("r08_assemble_training", "rows", """, a AS (SELECT *, 1.0 AS sw FROM (SELECT *, row_number() OVER (PARTITION BY image_id, label
    ORDER BY md5(concat_ws(':', 'ref', row_key))) AS rn FROM rows_ WHERE f3 <= 0.05) WHERE rn <= 40),
    b AS (SELECT *, 3.0 AS sw FROM (SELECT *, row_number() OVER (PARTITION BY image_id, label
    ORDER BY md5(concat_ws(':', 'fix', row_key))) AS rn FROM rows_ WHERE f3 > 0.05) WHERE rn <= 25),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b), c AS (SELECT label, count(*) AS n FROM u GROUP BY 1),
    t AS (SELECT count(*) AS n FROM u)
    SELECT image_id, label, count(*) AS n_rows, round(sum(t.n / (2.0 * c.n) * sw), 4) AS total_weight FROM u JOIN c USING (label), t
    GROUP BY 1, 2""")
def assemble_training(spark, root):
    r = T.rows(spark, root)
    w = assemble(r.filter("f3 <= 0.05"), r.filter("f3 > 0.05"), 40, 25, 3.0)
    return w.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("weight"), 4).alias("total_weight"))
