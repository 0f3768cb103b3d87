"""Label-layer queries: overlays, archives, imports, conflicts and name joins."""

from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.operators import labels as L
from rasterloom.plans.registry import query
from rasterloom.sources import tables as T

CNT = "{0}_c AS (SELECT image_id, count(*) FILTER (state = 1) AS n_pos, count(*) FILTER (state = 2) AS n_neg FROM {0} GROUP BY 1)"
SHAPES = f""", shapes AS (SELECT image_id, 1 AS a_height,
    CASE WHEN {T._sql_hash('shape', 'image_id')} < 0.15 THEN 5 ELSE 4 END AS a_width
    FROM (SELECT DISTINCT image_id FROM archive))"""


def archive_shapes(archive):
    width = F.when(T.unit_hash("shape", "image_id") < 0.15, 5).otherwise(4)
    return archive.select("image_id").distinct().select("image_id", F.lit(1).alias("a_height"), width.alias("a_width"))


@query("a13_snapshot_labels", "live archive", """, merged AS (SELECT *, 'live' AS origin FROM live UNION ALL
    SELECT *, 'carried' FROM archive WHERE image_id NOT IN (SELECT image_id FROM live)),
    per AS (SELECT origin, image_id, count(*) FILTER (state = 1) AS p, count(*) FILTER (state = 2) AS n
    FROM merged GROUP BY 1, 2)
    SELECT origin, image_id, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, count(*) AS n_images
    FROM per GROUP BY ROLLUP (origin, image_id)""")
def snapshot_labels(spark, root):
    return L.snapshot_manifest(L.merge_snapshot(T.live_labels(spark, root), T.archived_labels(spark, root)))


@query("a13_snapshot_labels_pruned", "live", """SELECT image_id, y, x, state FROM live""")
def snapshot_labels_pruned(spark, root):
    return L.merge_snapshot(T.live_labels(spark, root), T.archived_labels(spark, root), prune=True).drop("origin")


@query("a14_label_snapshot_status", "live archive", f""", {CNT.format('live')}, {CNT.format('archive')}
    SELECT coalesce(l.image_id, s.image_id) AS image_id, CASE WHEN s.image_id IS NULL THEN 'only_live'
    WHEN l.image_id IS NULL THEN 'only_saved' WHEN l.n_pos <> s.n_pos OR l.n_neg <> s.n_neg THEN 'changed'
    ELSE 'same' END AS status FROM live_c l FULL JOIN archive_c s ON l.image_id = s.image_id""")
def label_snapshot_status(spark, root):
    return L.snapshot_status(T.live_labels(spark, root), T.archived_labels(spark, root))


@query("a15_restore_labels", "live archive loaded", f""", {CNT.format('live')}, {CNT.format('archive')} {SHAPES}
    SELECT a.image_id, a.n_pos, a.n_neg, CASE WHEN f.image_id IS NULL THEN 'absent'
    WHEN coalesce(l.n_pos + l.n_neg, 0) > 0 THEN 'kept'
    WHEN height <> a_height OR width <> a_width THEN 'shape' ELSE 'wrote' END AS action
    FROM archive_c a JOIN shapes USING (image_id) LEFT JOIN loaded f ON a.image_id = f.image_id
    LEFT JOIN live_c l ON a.image_id = l.image_id""")
def restore_labels(spark, root):
    a = T.archived_labels(spark, root)
    return L.restore_plan(a, T.live_labels(spark, root), T.loaded_frames(spark, root), archive_shapes(a))


@query("a16_import_labels", "live archive loaded", f""", {CNT.format('live')}, {CNT.format('archive')} {SHAPES},
    plan AS (SELECT a.image_id, f.grp, a.n_neg, CASE WHEN f.image_id IS NULL THEN 'not loaded'
    WHEN height <> a_height OR width <> a_width THEN 'shape' WHEN coalesce(l.n_pos + l.n_neg, 0) > 0 THEN 'has labels'
    WHEN a.n_neg = 0 THEN 'no usable labels' END AS reason
    FROM archive_c a JOIN shapes USING (image_id) LEFT JOIN loaded f ON a.image_id = f.image_id
    LEFT JOIN live_c l ON a.image_id = l.image_id)
    SELECT grp, reason, count(*) AS n_masks, CAST(sum(n_neg) AS BIGINT) AS n_neg FROM plan GROUP BY ALL""")
def import_labels(spark, root):
    a = T.archived_labels(spark, root)
    plan = L.import_plan(a, T.live_labels(spark, root), T.loaded_frames(spark, root), archive_shapes(a))
    return plan.groupBy("grp", "reason").agg(F.count(F.lit(1)).alias("n_masks"), F.sum("n_neg").alias("n_neg"))


@query("a17_label_packing", "judged", """, m AS (SELECT *, x - lag(x) OVER w AS dx, lag(state) OVER w AS ps FROM judged
    WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
    r AS (SELECT *, sum(CASE WHEN dx = 1 AND ps = state THEN 0 ELSE 1 END) OVER (PARTITION BY image_id, y ORDER BY x)
    AS run FROM m)
    SELECT image_id, y, state, min(x) AS x0, max(x) AS x1 FROM r GROUP BY image_id, y, run, state""")
def label_packing(spark, root):
    return L.pack_runs(T.judged(spark, root))


@query("a17_label_unpacking", "judged", "SELECT image_id, y, x, state FROM judged")
def label_unpacking(spark, root):
    return L.unpack_runs(L.pack_runs(T.judged(spark, root)))


@query("e01_prediction_by_label", "scores judged", """SELECT image_id, y, x, coalesce(pa > 0.5, false) AS predicted,
    state FROM scores FULL JOIN judged USING (image_id, y, x)""")
def prediction_by_label(spark, root):
    j = T.scores(spark, root).select(*L.PIXEL, "pa").join(T.judged(spark, root), L.PIXEL, "full")
    return j.select(*L.PIXEL, F.coalesce(F.col("pa") > 0.5, F.lit(False)).alias("predicted"), "state")


@query("e02_label_file_by_stem", "live archive loaded", f""", {CNT.format('archive')} {SHAPES}
    SELECT a.image_id, CASE WHEN f.image_id IS NULL THEN 'not loaded' WHEN width <> a_width OR height <> a_height
    THEN 'shape' ELSE 'ok' END AS outcome FROM archive_c a JOIN shapes USING (image_id)
    LEFT JOIN loaded f ON a.image_id = f.image_id""")
def label_file_by_stem(spark, root):
    a = T.archived_labels(spark, root)
    j = archive_shapes(a).join(T.loaded_frames(spark, root), "image_id", "left")
    same = (F.col("width") == F.col("a_width")) & (F.col("height") == F.col("a_height"))
    return j.select("image_id", F.when(F.col("height").isNull(), "not loaded").when(~same, "shape")
                    .otherwise("ok").alias("outcome"))


@query("e03_truth_by_fragment", None, """WITH frag AS (SELECT DISTINCT upper(p_type) AS fragment FROM part UNION
    SELECT DISTINCT split_part(p_name, ' ', 2) FROM part), names AS (SELECT p_partkey AS image_id,
    concat(p_name, '_', lower(p_type), '_', p_size) AS name FROM part)
    SELECT fragment, min(image_id) AS image_id, count(*) AS n_matches FROM frag JOIN names
    ON contains(lower(name), lower(fragment)) GROUP BY 1""")
def truth_by_fragment(spark, root):
    p = T.table(spark, root, "part")
    frag = p.select(F.upper("p_type").alias("fragment")).union(p.select(F.split_part("p_name", F.lit(" "), F.lit(2)))).distinct()
    names = p.select(F.col("p_partkey").alias("image_id"),
                     F.concat("p_name", F.lit("_"), F.lower("p_type"), F.lit("_"), "p_size").alias("name"))
    return L.fragment_match(frag, names)


@query("e06_overrides", "scores", """, ov AS (SELECT doc_id, toxic = 1 AS is_pos FROM labels)
    SELECT s.doc_id, coalesce(o.is_pos, s.pa > 0.5) AS is_crack, o.is_pos IS NOT NULL AS overridden
    FROM scores s LEFT JOIN ov o USING (doc_id)""")
def overrides(spark, root):
    ov = T.table(spark, root, "labels").select("doc_id", (F.col("toxic") == 1).alias("o"))
    j = T.scores(spark, root).select("doc_id", "pa").join(ov, "doc_id", "left")
    return j.select("doc_id", F.coalesce("o", F.col("pa") > 0.5).alias("is_crack"), F.col("o").isNotNull().alias("overridden"))


FP = """, inc AS (SELECT model, round(avg(clean_fp), 6) AS fp FROM history WHERE status = 'F' GROUP BY 1),
    cand AS (SELECT model, round(avg(clean_fp), 6) AS fp FROM history WHERE status = 'O' GROUP BY 1)"""


def fp_by_model(spark, root, status):
    return T.history(spark, root).filter(F.col("status") == status).groupBy("model").agg(S.r6(F.avg("clean_fp")).alias("fp"))


@query("e07_fp_by_specimen", "history", FP + """
    SELECT c.model, i.fp AS before, c.fp AS after FROM cand c LEFT JOIN inc i USING (model)""")
def fp_by_specimen(spark, root):
    inc = fp_by_model(spark, root, "F").withColumnRenamed("fp", "before")
    return fp_by_model(spark, root, "O").withColumnRenamed("fp", "after").join(inc, "model", "left")


@query("e08_paired_runs", "history", """, arms AS (SELECT model, recipe, status, avg(iou) AS iou FROM history
    WHERE status IN ('F', 'O') GROUP BY ALL)
    SELECT a.model, a.recipe, round(a.iou, 6) AS iou_a, round(b.iou, 6) AS iou_b, round(b.iou - a.iou, 6) AS delta
    FROM arms a JOIN arms b ON a.model = b.model AND a.recipe = b.recipe WHERE a.status = 'F' AND b.status = 'O'""")
def paired_runs(spark, root):
    h = T.history(spark, root).filter(F.col("status").isin("F", "O"))
    arm = lambda s: F.avg(F.when(F.col("status") == s, F.col("iou")))
    j = h.groupBy("model", "recipe").agg(arm("F").alias("a"), arm("O").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    return j.select("model", "recipe", S.r6("a").alias("iou_a"), S.r6("b").alias("iou_b"),
                    S.r6(F.col("b") - F.col("a")).alias("delta"))


@query("e09_mask_agreement", "grid", """, a AS (SELECT image_id, y, x FROM grid WHERE p > 0.5),
    b AS (SELECT image_id, y, x FROM grid WHERE n > 1),
    j AS (SELECT image_id, a.y IS NOT NULL AS ina, b.y IS NOT NULL AS inb FROM a FULL JOIN b USING (image_id, y, x))
    SELECT image_id, count(*) FILTER (ina) AS area_a, count(*) FILTER (inb) AS area_b,
    round(count(*) FILTER (ina AND inb) / count(*)::DOUBLE, 6) AS agreement FROM j GROUP BY 1""")
def mask_agreement_query(spark, root):
    g = T.grid(spark, root)
    return mask_agreement(g.filter("p > 0.5"), g.filter("n > 1"))


def mask_agreement(a, b):
    """Areas and agreement of two masks of the same frames; an empty union gives NULL."""
    j = a.select(*L.PIXEL, F.lit(True).alias("ina")).join(b.select(*L.PIXEL, F.lit(True).alias("inb")), L.PIXEL, "full")
    both = F.count_if(F.coalesce(F.col("ina") & F.col("inb"), F.lit(False)))
    return j.groupBy("image_id").agg(F.count("ina").alias("area_a"), F.count("inb").alias("area_b"),
                                     S.r6(both / F.count(F.lit(1))).alias("agreement"))


@query("e11_confirmed_clean_removed", "judged", """, clean AS (SELECT image_id FROM judged GROUP BY 1
    HAVING count(*) FILTER (state = 1) <= 2)
    SELECT image_id, y, x FROM judged WHERE state = 1 AND image_id NOT IN (SELECT image_id FROM clean)""")
def confirmed_clean_removed(spark, root):
    j = T.judged(spark, root)
    clean = L.label_counts(j).filter("n_pos <= 2").select("image_id")
    return j.filter("state = 1").join(clean, "image_id", "left_anti").select(*L.PIXEL)


@query("e12_review_verdict", "scores", """, rev AS (SELECT doc_id, quality = 1 AS usable FROM labels),
    ver AS (SELECT doc_id, pa > 0.4 AS agree FROM scores)
    SELECT rev.doc_id FROM rev LEFT JOIN ver USING (doc_id) WHERE NOT usable AND coalesce(agree, false)""")
def review_verdict(spark, root):
    rev = T.table(spark, root, "labels").select("doc_id", (F.col("quality") == 1).alias("usable"))
    ver = T.scores(spark, root).select("doc_id", (F.col("pa") > 0.4).alias("agree"))
    return rev.join(ver, "doc_id", "left").filter("NOT usable AND coalesce(agree, false)").select("doc_id")


@query("e13_merged_runs", "history", """, base AS (SELECT model, round(avg(iou), 6) AS iou FROM history
    WHERE status = 'F' GROUP BY 1), fixed AS (SELECT model, round(avg(CASE WHEN recipe = '1-URGENT' THEN iou END), 6) AS iou
    FROM history WHERE status = 'O' GROUP BY 1)
    SELECT coalesce(f.model, b.model) AS model, coalesce(f.iou, b.iou) AS iou, CASE WHEN f.iou IS NOT NULL OR b.model IS NULL
    THEN 'fixed' ELSE 'base' END AS source FROM base b FULL JOIN fixed f ON b.model = f.model""")
def merged_runs(spark, root):
    h = T.history(spark, root)
    base = h.filter("status = 'F'").groupBy("model").agg(S.r6(F.avg("iou")).alias("b"), F.lit(True).alias("has_b"))
    fixed = h.filter("status = 'O'").groupBy("model").agg(
        S.r6(F.avg(F.when(F.col("recipe") == "1-URGENT", F.col("iou")))).alias("f"))
    use_fixed = F.col("f").isNotNull() | F.col("has_b").isNull()
    return base.join(fixed, "model", "full").select(
        "model", F.coalesce("f", "b").alias("iou"), F.when(use_fixed, "fixed").otherwise("base").alias("source"))


MASKS = """, a AS (SELECT image_id, y, x FROM grid WHERE p > 0.5), b AS (SELECT image_id, y, x FROM grid WHERE n > 1)"""


@query("i01_mask_set_areas", "grid", MASKS + """, u AS (SELECT * FROM a UNION SELECT * FROM b),
    i AS (SELECT * FROM a INTERSECT SELECT * FROM b), d AS (SELECT * FROM a EXCEPT SELECT * FROM b)
    SELECT image_id, count(*) FILTER (op = 'u') AS n_union, count(*) FILTER (op = 'i') AS n_intersection,
    count(*) FILTER (op = 'd') AS n_difference FROM (SELECT image_id, 'u' AS op FROM u UNION ALL
    SELECT image_id, 'i' FROM i UNION ALL SELECT image_id, 'd' FROM d) GROUP BY 1""")
def mask_set_areas(spark, root):
    g = T.grid(spark, root)
    a, b = g.filter("p > 0.5").select(*L.PIXEL), g.filter("n > 1").select(*L.PIXEL)
    tag = lambda df, op: df.select("image_id", F.lit(op).alias("op"))
    alls = tag(a.union(b).distinct(), "u").union(tag(a.intersect(b), "i")).union(tag(a.exceptAll(b), "d"))
    return alls.groupBy("image_id").agg(
        F.count_if(F.col("op") == "u").alias("n_union"), F.count_if(F.col("op") == "i").alias("n_intersection"),
        F.count_if(F.col("op") == "d").alias("n_difference"))


@query("i02_carry_forward", "live archive", """SELECT image_id, y, x, state FROM live UNION ALL
    SELECT image_id, y, x, state FROM archive WHERE image_id NOT IN (SELECT image_id FROM live)""")
def carry_forward(spark, root):
    return L.merge_snapshot(T.live_labels(spark, root), T.archived_labels(spark, root)).drop("origin")


@query("i03_never_clobber_write", "live archive", """SELECT image_id, y, x, state FROM live UNION ALL
    SELECT image_id, y, x, state FROM archive a WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.image_id = a.image_id
    AND l.y = a.y AND l.x = a.x)""")
def never_clobber_write(spark, root):
    return L.write_where_silent(T.live_labels(spark, root), T.archived_labels(spark, root))


@query("i04_clear_conflicts", "judged scores", """, j AS (SELECT jd.*, s.is_pos FROM judged jd LEFT JOIN scores s
    USING (image_id, y, x)), k AS (SELECT *, (state = 2 AND is_pos) OR (state = 1 AND NOT is_pos) AS bad FROM j)
    SELECT image_id, count(*) FILTER (state = 1) AS pos_before, count(*) FILTER (state = 2) AS neg_before,
    count(*) FILTER (state = 1 AND NOT coalesce(bad, false)) AS pos_after,
    count(*) FILTER (state = 2 AND NOT coalesce(bad, false)) AS neg_after FROM k GROUP BY 1""")
def clear_conflicts_query(spark, root):
    lab, truth = T.judged(spark, root), T.scores(spark, root)
    before = L.label_counts(lab).withColumnsRenamed({"n_pos": "pos_before", "n_neg": "neg_before"})
    after = L.label_counts(L.clear_conflicts(lab, truth, both_sides=True))
    return before.join(after, "image_id", "left").select(
        "image_id", "pos_before", "neg_before", F.coalesce("n_pos", F.lit(0)).alias("pos_after"),
        F.coalesce("n_neg", F.lit(0)).alias("neg_after"))


@query("i04_clear_negatives_only", "judged scores", """SELECT jd.image_id, jd.y, jd.x, jd.state FROM judged jd
    LEFT JOIN scores s USING (image_id, y, x) WHERE NOT (jd.state = 2 AND coalesce(s.is_pos, false))""")
def clear_negatives_only(spark, root):
    return L.clear_conflicts(T.judged(spark, root), T.scores(spark, root))


@query("i05_confirmed_clean_frames", "judged scores", """, clean AS (SELECT image_id FROM judged GROUP BY 1
    HAVING count(*) FILTER (state = 1) <= 2), inside AS (SELECT image_id, y, x FROM scores
    WHERE n_chars > 400 AND image_id IN (FROM clean))
    SELECT image_id, y, x, state FROM judged WHERE image_id NOT IN (FROM clean)
    UNION ALL SELECT image_id, y, x, 2 FROM (SELECT * FROM inside UNION SELECT image_id, y, x FROM judged
    WHERE state = 2 AND image_id IN (FROM clean))""")
def confirmed_clean_frames(spark, root):
    lab = T.judged(spark, root)
    clean = L.label_counts(lab).filter("n_pos <= 2")
    return L.confirm_clean(lab, clean, T.scores(spark, root).filter("n_chars > 400"))
