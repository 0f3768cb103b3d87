"""Window, sort and top-k queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.operators import labels as L
from rasterloom.operators.ordered import previous_value, sliding
from rasterloom.plans.labels import mask_agreement
from rasterloom.plans.registry import query
from rasterloom.sources import tables as T


def newest(keys, *order):
    return Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])


@query("g01_undo_depth", "strokes", """SELECT image_id, stroke_id, depth FROM (SELECT *, row_number() OVER
    (PARTITION BY image_id ORDER BY ts DESC, stroke_id DESC) AS depth FROM strokes) WHERE depth <= 30""")
def undo_depth(spark, root):
    s = T.strokes(spark, root)
    return s.withColumn("depth", F.row_number().over(newest(["image_id"], "ts", "stroke_id"))).filter(
        "depth <= 30").select("image_id", "stroke_id", F.col("depth").cast("long").alias("depth"))


@query("g02_prediction_cache", "history", """SELECT model, seq FROM (SELECT *, row_number() OVER
    (PARTITION BY model ORDER BY created DESC, seq DESC) AS rn FROM history) WHERE rn <= 6 OR recipe = '1-URGENT'""")
def prediction_cache(spark, root):
    h = T.history(spark, root)
    recent = h.withColumn("rn", F.row_number().over(newest(["model"], "created", "seq"))).filter("rn <= 6")
    current = h.filter("recipe = '1-URGENT'")
    return recent.select("model", "seq").union(current.select("model", "seq")).distinct()


@query("g03_same_recipe_baseline", "history", """, s AS (SELECT *, last_value(CASE WHEN status <> 'P' THEN iou END IGNORE NULLS)
    OVER (PARTITION BY recipe ORDER BY created, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM history)
    SELECT seq, round(b, 6) AS baseline, CASE WHEN b IS NULL THEN iou >= 0.60 ELSE iou >= b - 0.01 END AS heldout_ok FROM s""")
def same_recipe_baseline(spark, root):
    """Pending runs (status P) have no score yet and are no baseline."""
    scored = T.history(spark, root).withColumn("scored", F.when(F.col("status") != "P", F.col("iou")))
    out = previous_value(scored, ["recipe"], F.date_trunc("month", "created"), ["created", "seq"], "scored")
    ok = F.when(F.col("previous").isNull(), F.col("iou") >= 0.60).otherwise(F.col("iou") >= F.col("previous") - 0.01)
    return out.select("seq", S.r6("previous").alias("baseline"), ok.alias("heldout_ok"))


@query("g04_retrain_trend", "history", """SELECT seq, round(iou, 6) AS iou, round(iou - prev, 6) AS change, age FROM (
    SELECT seq, iou, lag(iou) OVER (ORDER BY created, seq) AS prev, row_number() OVER (ORDER BY created DESC, seq DESC) AS age
    FROM history) WHERE age <= 20""")
def retrain_trend(spark, root):
    last = T.history(spark, root).orderBy(F.desc("created"), F.desc("seq")).limit(21)
    w = Window.orderBy(F.desc("created"), F.desc("seq"))
    out = last.withColumn("age", F.row_number().over(w).cast("long")).withColumn("prev", F.lead("iou").over(w))
    return out.filter("age <= 20").select("seq", S.r6("iou").alias("iou"), S.r6(F.col("iou") - F.col("prev")).alias("change"), "age")


@query("g05_best_of_flags", "history", """, m AS (SELECT model, avg(clean_fp) AS fp FROM history GROUP BY 1)
    SELECT model, round(fp, 6) AS clean_fp, fp > greatest(5 * (SELECT min(fp) FROM m), (SELECT min(fp) FROM m) + 0.01) AS fp_warn
    FROM m""")
def best_of_flags(spark, root):
    m = T.history(spark, root).groupBy("model").agg(F.avg("clean_fp").alias("fp"))
    best = m.select(F.min("fp")).scalar()
    return m.select("model", S.r6("fp").alias("clean_fp"), (F.col("fp") > F.greatest(best * 5, best + 0.01)).alias("fp_warn"))


PROFILE = """, prof AS (SELECT image_id, y, sum(s) AS m FROM grid GROUP BY 1, 2)"""


@query("g06_trailing_max", "grid", PROFILE + """ SELECT image_id, y, round(max(m) OVER (PARTITION BY image_id ORDER BY y
    RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS trailing FROM prof""")
def trailing_max(spark, root):
    prof = T.grid(spark, root).groupBy("image_id", "y").agg(F.sum("s").alias("m"))
    out = sliding(prof, ["image_id"], "y", 10, -1, {"trailing": F.max("m")}, block=64)
    return out.select("image_id", "y", S.r6("trailing").alias("trailing"))


@query("g07_moving_average_detrend", "grid", PROFILE + """ SELECT image_id, y,
    round(m - sum(m) OVER (PARTITION BY image_id ORDER BY y RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15, 6) AS d15,
    round(m - sum(m) OVER (PARTITION BY image_id ORDER BY y RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING) / 25, 6) AS d25,
    round(m - sum(m) OVER (PARTITION BY image_id ORDER BY y RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) / 41, 6) AS d41
    FROM prof""")
def moving_average_detrend(spark, root):
    out = T.grid(spark, root).groupBy("image_id", "y").agg(F.sum("s").alias("m"))
    for w in (15, 25, 41):
        out = sliding(out, ["image_id"], "y", w // 2, w // 2, {f"a{w}": F.sum("m")}, block=128)
    return out.select("image_id", "y", *[S.r6(F.col("m") - F.col(f"a{w}") / w).alias(f"d{w}") for w in (15, 25, 41)])


@query("g08_tile_budget", "judged", """, f AS (SELECT image_id, least(count(*) FILTER (state = 1), 3) AS want FROM judged GROUP BY 1
    HAVING count(*) FILTER (state = 1) > 0), r AS (SELECT *, CAST(sum(want) OVER (ORDER BY image_id) - want AS BIGINT) AS before FROM f)
    SELECT image_id, CAST(least(want, 25 - before) AS BIGINT) AS tiles FROM r WHERE before < 25""")
def tile_budget(spark, root):
    budget = 25
    offers = L.label_counts(T.judged(spark, root)).filter("n_pos > 0").select(
        "image_id", F.least("n_pos", F.lit(3)).alias("want")).orderBy("image_id").limit(budget)
    before = F.sum("want").over(Window.orderBy("image_id")) - F.col("want")
    return offers.withColumn("before", before).filter(F.col("before") < budget).select(
        "image_id", F.least("want", F.lit(budget) - F.col("before")).alias("tiles"))


@query("h01_model_list", "history", """, e AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY created DESC, seq DESC) AS rn,
    bool_or(status = 'F') OVER (PARTITION BY model) AND bool_or(status = 'O') OVER (PARTITION BY model) AS complete FROM history),
    cur AS (SELECT max(created) AS c FROM history)
    SELECT model, created, CASE WHEN created = (SELECT c FROM cur) THEN 0 WHEN created < TIMESTAMP '1999-01-01' THEN 2 ELSE 1 END AS tier
    FROM e WHERE rn = 1 AND complete""")
def model_list(spark, root):
    h = T.history(spark, root)
    latest = h.select(F.max("created")).scalar()
    per = h.groupBy("model").agg(F.max("created").alias("created"), F.bool_or(F.col("status") == "F").alias("f"),
                                 F.bool_or(F.col("status") == "O").alias("o")).filter("f AND o")
    tier = F.when(F.col("created") == latest, 0).when(F.col("created") < F.lit("1999-01-01").cast("timestamp_ntz"), 2).otherwise(1)
    return per.select("model", "created", tier.alias("tier")).orderBy("tier", F.desc("created"), "model")


@query("h02_worklist", "scores judged", """, a AS (SELECT image_id, avg(CAST(pa > 0.5 AS INT)) AS area FROM scores GROUP BY 1),
    d AS (SELECT DISTINCT image_id FROM judged WHERE state = 1)
    SELECT image_id, CASE WHEN image_id LIKE 'src1%' THEN 0 WHEN image_id LIKE 'src2%' THEN 1 ELSE 9 END AS priority,
    round(area, 6) AS area, image_id IN (FROM d) AS done FROM a""")
def worklist(spark, root):
    area = T.scores(spark, root).groupBy("image_id").agg(S.r6(F.avg((F.col("pa") > 0.5).cast("int"))).alias("area"))
    done = T.judged(spark, root).filter("state = 1").select("image_id").distinct().withColumn("d", F.lit(True))
    pr = F.when(F.col("image_id").startswith("src1"), 0).when(F.col("image_id").startswith("src2"), 1).otherwise(9)
    return area.join(done, "image_id", "left").select(
        "image_id", pr.alias("priority"), "area", F.coalesce("d", F.lit(False)).alias("done")).orderBy("priority", F.desc("area"), "image_id")


@query("h03_lowest_agreement", "scores", """, a AS (SELECT image_id, round(count(*) FILTER (pa > 0.5 AND pb > 0.5)
    / count(*) FILTER (pa > 0.5 OR pb > 0.5), 6) AS agreement FROM scores GROUP BY 1)
    SELECT image_id, agreement FROM a ORDER BY agreement, image_id LIMIT 12""")
def lowest_agreement(spark, root):
    s = T.scores(spark, root)
    a = mask_agreement(s.filter("pa > 0.5"), s.filter("pb > 0.5"))
    return a.select("image_id", "agreement").orderBy("agreement", "image_id").limit(12)


@query("h04_top_features", "px8", """SELECT concat('f', y, x) AS feature, round(stddev_pop(v), 6) AS importance FROM px8
    GROUP BY y, x ORDER BY stddev_pop(v) DESC LIMIT 4""")
def top_features(spark, root):
    imp = T.px8(spark, root).groupBy("y", "x").agg(F.stddev_pop("v").alias("i"))
    return imp.orderBy(F.desc("i")).limit(4).select(F.concat(F.lit("f"), "y", "x").alias("feature"), S.r6("i").alias("importance"))


@query("h05_dense_targets", "live", """, c AS (SELECT image_id, count(*) FILTER (state = 1) AS n_pos, count(*) / 4.0 AS frac
    FROM live GROUP BY 1) SELECT image_id, n_pos, round(CAST(frac AS DOUBLE), 6) AS judged FROM c WHERE frac >= 0.75 AND n_pos >= 1""")
def dense_targets(spark, root):
    c = L.label_counts(T.live_labels(spark, root)).withColumn("judged", S.r6((F.col("n_pos") + F.col("n_neg")) / 4.0))
    return c.filter("judged >= 0.75 AND n_pos >= 1").select("image_id", "n_pos", "judged").orderBy(F.desc("judged"), "image_id")


@query("h06_best_passing_candidate", "history", """SELECT recipe, arg_max(seq, iou) AS seq, round(max(iou), 6) AS iou FROM history
    WHERE iou >= 0.60 AND clean_fp <= 0.02 GROUP BY 1""")
def best_passing_candidate(spark, root):
    ok = T.history(spark, root).filter("iou >= 0.60 AND clean_fp <= 0.02")
    return ok.groupBy("recipe").agg(F.max_by("seq", "iou").alias("seq"), S.r6(F.max("iou")).alias("iou"))
