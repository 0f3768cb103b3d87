"""Model registry, switching and re-application queries."""

from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.plans.gates import FRAMES_SQL, frames, latest_prediction, predictions
from rasterloom.plans.registry import query
from rasterloom.sources import tables as T


def model_key(stamp, paths, kind):
    """The retrain stamp if there is one, else a digest of the files' identity; sanitised to 40 characters.

    ``paths`` are structs of path, size and mtime; the digest text is the JSON list of those
    triples followed by the kind.
    """
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    triples = [F.when(p["path"].isNull(), "[null, null, null]").otherwise(F.concat(
        F.lit("["), quoted(p["path"]), F.lit(", "), p["size"].cast("string"), F.lit(", "), p["mtime"].cast("string"), F.lit("]"))) for p in paths]
    ident = F.concat(F.lit("["), *[x for t in triples for x in (t, F.lit(", "))], quoted(kind), F.lit("]"))
    base = F.coalesce(F.when(stamp != "", stamp), F.concat(F.lit("m"), F.substring(F.sha1(ident), 1, 10)))
    return F.substring(F.regexp_replace(base, r"[^\p{L}\p{N}_-]", "_"), 1, 40)


@query("r01_model_key", "history", r""", k AS (SELECT seq, CASE WHEN status = 'F' THEN strftime(created, '%Y-%m-%d %H:%M') END AS stamp,
    concat('[["models/', model, '.bin", ', seq, ', ', model, '], [null, null, null], "', recipe, '"]') AS ident FROM history)
    SELECT seq, substr(regexp_replace(coalesce(stamp, concat('m', substr(sha1(ident), 1, 10))), '[^\p{L}\p{N}_-]', '_', 'g'), 1, 40)
    AS model_key FROM k""")
def model_key_query(spark, root):
    h = T.history(spark, root)
    none = F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("mtime"))
    one = F.struct(F.concat(F.lit("models/"), "model", F.lit(".bin")).alias("path"), F.col("seq").alias("size"), F.col("model").alias("mtime"))
    stamp = F.when(F.col("status") == "F", F.date_format("created", "yyyy-MM-dd HH:mm"))
    return h.select("seq", model_key(stamp, [one, none], F.col("recipe")).alias("model_key"))


@query("r02_set_current", "history", """, c AS (SELECT recipe, arg_max(model, (created, seq)) AS current FROM history GROUP BY 1)
    SELECT DISTINCT h.recipe, h.model, h.model = c.current AS is_current FROM history h JOIN c USING (recipe)""")
def set_current(spark, root):
    """Registry per recipe from its selection events: the last selected is current, every other key is history once."""
    h = T.history(spark, root)
    per = h.groupBy("recipe", "model").agg(F.max(F.struct("created", "seq")).alias("last"))
    current = per.groupBy("recipe").agg(F.max_by("model", "last").alias("current"))
    return per.join(current, "recipe").select("recipe", "model", (F.col("model") == F.col("current")).alias("is_current"))


@query("r03_rollback", "history", """, c AS (SELECT recipe, arg_max(model, (created, seq)) AS current FROM history GROUP BY 1),
    p AS (SELECT recipe, any_value(current) AS rolled_back, arg_max(model, (created, seq)) AS current FROM history JOIN c USING (recipe)
    WHERE model <> c.current GROUP BY 1)
    SELECT recipe, current, rolled_back FROM p""")
def rollback(spark, root):
    """The previously selected model becomes current and the current one goes to history."""
    per = T.history(spark, root).groupBy("recipe", "model").agg(F.max(F.struct("created", "seq")).alias("last"))
    current = per.groupBy("recipe").agg(F.max_by("model", "last").alias("rolled_back"))
    other = per.join(current, "recipe").filter(F.col("model") != F.col("rolled_back"))
    return other.groupBy("recipe").agg(F.max_by("model", "last").alias("current"), F.first("rolled_back").alias("rolled_back"))


@query("r03_rollback_history", "history", """, l AS (SELECT recipe, model, max((created, seq)) AS last FROM history GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY recipe ORDER BY last DESC) AS age FROM l)
    SELECT recipe, model FROM k WHERE age = 1 OR age BETWEEN 3 AND 21""")
def rollback_history(spark, root):
    """Registry history after a rollback, bounded to its 20 latest entries.

    The model that became current (the second latest) leaves history and the one it replaced joins it as the latest.
    """
    from pyspark.sql import Window

    per = T.history(spark, root).groupBy("recipe", "model").agg(F.max(F.struct("created", "seq")).alias("last"))
    w = Window.partitionBy("recipe").orderBy(F.desc("last"))
    return per.withColumn("age", F.row_number().over(w)).filter("age = 1 OR age BETWEEN 3 AND 21").select("recipe", "model")


@query("r04_switch_plan", None, f"""WITH {FRAMES_SQL} SELECT f.image_id, CASE WHEN EXISTS (SELECT 1 FROM preds p WHERE p.image_id = f.image_id
    AND p.model_key = '2-HIGH') THEN 'instant' ELSE 'pending' END AS plan, f.image_id = 7 AS focus FROM frames f""")
def switch_plan(spark, root):
    have = predictions(spark, root).filter("model_key = '2-HIGH'").select("image_id").distinct().withColumn("_h", F.lit(True))
    j = frames(spark, root).join(have, "image_id", "left")
    return j.select("image_id", F.when(F.col("_h"), "instant").otherwise("pending").alias("plan"),
                    (F.col("image_id") == 7).alias("focus")).orderBy(F.desc("focus"), "image_id")


@query("r05_cached_for", None, f"""WITH {FRAMES_SQL} SELECT model_key, count(DISTINCT image_id) AS cached_for,
    (SELECT count(*) FROM frames) AS n_images FROM preds GROUP BY 1""")
def cached_for(spark, root):
    total = frames(spark, root).agg(F.count(F.lit(1))).scalar()
    per = predictions(spark, root).groupBy("model_key").agg(F.countDistinct("image_id").alias("cached_for"))
    return per.select("model_key", "cached_for", total.alias("n_images"))


@query("a09_image_list", None, f"""WITH {FRAMES_SQL}, strokes AS (SELECT user_id AS image_id, count(*) FILTER (event_type IN ('purchase', 'view'))
    AS n_pos, count(*) FILTER (event_type IN ('click', 'signup')) AS n_neg FROM events GROUP BY 1)
    SELECT f.image_id, filename, status, l.model_key, l.model_key IS NOT NULL AS has_prob, coalesce(l.model_key <> '2-HIGH', false) AS stale,
    coalesce(n_pos, 0) AS n_pos, coalesce(n_neg, 0) AS n_neg FROM frames f LEFT JOIN last l USING (image_id) LEFT JOIN strokes s USING (image_id)""")
def image_list(spark, root):
    strokes = T.table(spark, root, "events").groupBy(F.col("user_id").alias("image_id")).agg(
        F.count_if(F.col("event_type").isin("purchase", "view")).alias("p"), F.count_if(F.col("event_type").isin("click", "signup")).alias("n"))
    j = frames(spark, root).join(latest_prediction(predictions(spark, root)), "image_id", "left").join(strokes, "image_id", "left")
    zero = F.lit(0).cast("long")
    return j.select("image_id", "filename", "status", "model_key", F.col("model_key").isNotNull().alias("has_prob"),
                    F.coalesce(F.col("model_key") != "2-HIGH", F.lit(False)).alias("stale"),
                    F.coalesce("p", zero).alias("n_pos"), F.coalesce("n", zero).alias("n_neg"))


def counterparts(raw, processed):
    """Processed file of each raw file: the rewritten path first, else the same base name; shapes must agree.

    Base names shared by several processed files resolve to the first path.
    """
    base = lambda c: F.regexp_replace(c, r"^.*/", "")
    by_path = processed.select(F.col("path").alias("want"), F.struct("path", "height", "width").alias("a"))
    by_base = processed.groupBy(base(F.col("path")).alias("base")).agg(F.min(F.struct("path", "height", "width")).alias("b"))
    r = raw.withColumn("want", F.regexp_replace("path", r"^https?://", "flat://")).withColumn("base", base(F.col("path")))
    j = r.join(by_path, "want", "left").join(by_base, "base", "left").withColumn("hit", F.coalesce("a", "b"))
    same = (F.col("hit.height") == F.col("height")) & (F.col("hit.width") == F.col("width"))
    outcome = F.when(F.col("hit").isNull(), "missing").when(~same, "shape").otherwise(F.when(F.col("a").isNotNull(), "path").otherwise("name"))
    return j.select("image_id", F.when(same, F.col("hit.path")).alias("counterpart"), outcome.alias("outcome"))


@query("r07_counterpart", None, r"""WITH raw AS (SELECT page_id, url AS path, length(html) % 97 AS height, 64 AS width, length(html) AS n FROM pages),
    pr AS (SELECT CASE WHEN path LIKE 'https%' THEN regexp_replace(path, '^https?://', 'flat://') ELSE concat('other://', regexp_replace(path, '^.*/', '')) END AS path,
    CASE WHEN n % 10 = 0 THEN height + 1 ELSE height END AS height, width FROM raw WHERE NOT contains(path, '?')),
    bb AS (SELECT regexp_replace(path, '^.*/', '') AS base, min((path, height, width)) AS b FROM pr GROUP BY 1),
    j AS (SELECT page_id, r.height, r.width, p.path AS pp, coalesce(p.path, struct_extract_at(b, 1)) AS hp, coalesce(p.height, struct_extract_at(b, 2)) AS hh FROM raw r
    LEFT JOIN pr p ON p.path = regexp_replace(r.path, '^https?://', 'flat://') LEFT JOIN bb ON base = regexp_replace(r.path, '^.*/', ''))
    SELECT page_id AS image_id, CASE WHEN hh = height THEN hp END AS counterpart, CASE WHEN hp IS NULL THEN 'missing' WHEN hh <> height THEN 'shape'
    WHEN pp IS NOT NULL THEN 'path' ELSE 'name' END AS outcome FROM j""")
def counterpart(spark, root):
    """Pages without a query string have a processed counterpart: beside their path if secure, else by name; some have another height."""
    raw = T.table(spark, root, "pages").select(F.col("page_id").alias("image_id"), F.col("url").alias("path"),
                                               (F.length("html") % 97).alias("height"), F.lit(64).alias("width"), F.length("html").alias("n"))
    path = F.when(F.col("path").startswith("https"), F.regexp_replace("path", r"^https?://", "flat://")).otherwise(
        F.concat(F.lit("other://"), F.regexp_replace("path", r"^.*/", "")))
    processed = raw.filter(~F.col("path").contains("?")).select(
        path.alias("path"), F.when(F.col("n") % 10 == 0, F.col("height") + 1).otherwise(F.col("height")).alias("height"), "width")
    return counterparts(raw.drop("n"), processed)
