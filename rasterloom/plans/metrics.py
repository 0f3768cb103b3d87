"""Metric and paired-statistics queries."""

from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.operators import aggregates as A
from rasterloom.operators import labels as L
from rasterloom.operators import metrics as M
from rasterloom.plans.registry import query
from rasterloom.sources import tables as T

CONF = """count(*) FILTER ({p} AND is_pos) AS tp, count(*) FILTER ({p} AND NOT is_pos) AS fp,
    count(*) FILTER (NOT ({p}) AND is_pos) AS fn"""


def per_image(spark, root, model, keys=("image_id",)):
    return A.confusion(T.scores(spark, root), list(keys), F.col(model) > 0.5, F.col("is_pos"))


@query("n01_overlap_scores", "scores", f""", c AS (SELECT image_id, {CONF.format(p='pa > 0.5')} FROM scores GROUP BY 1)
    SELECT image_id, round(tp / (tp + fp + fn), 6) AS iou, round(2 * tp / (2 * tp + fp + fn), 6) AS dice,
    round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall FROM c""")
def overlap_scores(spark, root):
    out = M.overlap_scores(per_image(spark, root, "pa"))
    return out.select("image_id", *[S.r6(c).alias(c) for c in ("iou", "dice", "precision", "recall")])


@query("n02_masked_iou", "scores judged", """, j AS (SELECT image_id, pa > 0.5 AS p, state = 1 AS t FROM judged JOIN scores
    USING (image_id, y, x)) SELECT image_id, count(*) AS n_judged, round(count(*) FILTER (p AND t) /
    nullif(count(*) FILTER (p OR t), 0), 6) AS iou FROM j GROUP BY 1""")
def masked_iou(spark, root):
    j = T.judged(spark, root).join(T.scores(spark, root).select(*L.PIXEL, "pa"), L.PIXEL)
    c = A.confusion(j, ["image_id"], F.col("pa") > 0.5, F.col("state") == 1)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select("image_id", n.alias("n_judged"), S.r6(S.iou(F.col("tp"), F.col("fp"), F.col("fn"))).alias("iou"))


@query("n03_agreement", "scores judged", """SELECT lang, round(avg(CASE WHEN state = 1 THEN CAST(pa > 0.5 AS INT) END), 6) AS pos_recall,
    round(avg(CASE WHEN state = 2 THEN CAST(pa <= 0.5 AS INT) END), 6) AS neg_agreement FROM judged JOIN scores USING (image_id, y, x)
    GROUP BY 1""")
def agreement(spark, root):
    j = T.judged(spark, root).join(T.scores(spark, root).select(*L.PIXEL, "pa", "lang"), L.PIXEL)
    hit = (F.col("pa") > 0.5).cast("int")
    return j.groupBy("lang").agg(S.r6(F.avg(F.when(F.col("state") == 1, hit))).alias("pos_recall"),
                                 S.r6(F.avg(F.when(F.col("state") == 2, 1 - hit))).alias("neg_agreement"))


@query("n04_threshold_free", "scores", """, t AS (SELECT lang, round(pa, 2) AS p, count(*) FILTER (is_pos) AS pos,
    count(*) FILTER (NOT is_pos) AS neg FROM scores GROUP BY 1, 2),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER a AS pp, sum(neg) OVER a AS nn FROM t
    WINDOW w AS (PARTITION BY lang ORDER BY p DESC), a AS (PARTITION BY lang)),
    pts AS (SELECT lang, fp / nn AS f, tp / pp AS t FROM c UNION ALL SELECT DISTINCT lang, 0, 0 FROM c),
    seg AS (SELECT lang, tgt, max((f, t)) FILTER (f <= tgt) AS a, min((f, t)) FILTER (f > tgt) AS b FROM pts,
    (VALUES (0.05::DOUBLE), (0.10::DOUBLE)) v(tgt) GROUP BY 1, 2),
    r AS (SELECT lang, tgt, struct_extract_at(a, 2) + (struct_extract_at(b, 2) - struct_extract_at(a, 2)) *
    (tgt - struct_extract_at(a, 1)) / (struct_extract_at(b, 1) - struct_extract_at(a, 1)) AS r FROM seg)
    SELECT lang, round((SELECT sum(pos * (nn - fp + neg / 2.0)) / any_value(pp * nn) FROM c WHERE c.lang = r.lang), 6) AS auc,
    round(max(r) FILTER (tgt < 0.07), 6) AS r05, round(max(r) FILTER (tgt > 0.07), 6) AS r10 FROM r GROUP BY lang""")
def threshold_free(spark, root):
    s = T.scores(spark, root).withColumn("p", F.round("pa", 2))
    out = M.threshold_free(s, ["lang"], "p", F.col("is_pos"))
    return out.select("lang", *[S.r6(c).alias(c) for c in ("auc", "r05", "r10")])


@query("n04_fpr", "scores", """SELECT lang, round(count(*) FILTER (pa > 0.5 AND NOT is_pos) / greatest(count(*) FILTER (NOT is_pos), 1), 6)
    AS fpr, round(count(*) FILTER (pb > 0.5 AND NOT is_pos) / greatest(count(*) FILTER (NOT is_pos), 1), 6) AS fpr_b
    FROM scores GROUP BY 1""")
def fpr(spark, root):
    neg = ~F.col("is_pos")
    rate = lambda m: S.r6(F.count_if((F.col(m) > 0.5) & neg) / F.greatest(F.count_if(neg), F.lit(1)))
    return T.scores(spark, root).groupBy("lang").agg(rate("pa").alias("fpr"), rate("pb").alias("fpr_b"))


PAIRS = f""", ca AS (SELECT lang, image_id, count(*) AS w, {CONF.format(p='pa > 0.5')} FROM scores GROUP BY 1, 2),
    cb AS (SELECT lang, image_id, {CONF.format(p='pb > 0.5')} FROM scores GROUP BY 1, 2),
    pairs AS (SELECT ca.lang, ca.image_id, w, round(ca.tp / greatest(ca.tp + ca.fp + ca.fn, 1), 4) AS a,
    round(cb.tp / greatest(cb.tp + cb.fp + cb.fn, 1), 4) AS b FROM ca JOIN cb USING (lang, image_id)),
    d AS (SELECT *, round(b - a, 4) AS delta FROM pairs)"""


def pairs(spark, root):
    """IoU of both models per language and frame, from one aggregate."""
    s, pos = T.scores(spark, root), F.col("is_pos")

    def score(m):
        p = F.col(m) > 0.5
        tp, union = F.count_if(p & pos), F.count_if(p | pos)
        return F.round(tp / F.greatest(union, F.lit(1)), 4)

    out = s.groupBy("lang", "image_id").agg(F.count(F.lit(1)).alias("w"), score("pa").alias("a"), score("pb").alias("b"))
    return out.withColumn("delta", F.round(F.col("b") - F.col("a"), 4))


@query("n05_pixel_weighted_mean", "scores", PAIRS + """, s AS (SELECT lang, avg(a) AS ua, avg(b) AS ub, sum(a * w) / sum(w) AS wa,
    sum(b * w) / sum(w) AS wb FROM d GROUP BY 1)
    SELECT lang, round(ua, 6) AS mean_a, round(ub, 6) AS mean_b, round(wa, 6) AS weighted_a, round(wb, 6) AS weighted_b,
    (ua > ub) <> (wa > wb) AS flips FROM s""")
def pixel_weighted_mean(spark, root):
    wavg = lambda c: F.sum(F.col(c) * F.col("w")) / F.sum("w")
    s = pairs(spark, root).groupBy("lang").agg(F.avg("a").alias("ua"), F.avg("b").alias("ub"), wavg("a").alias("wa"), wavg("b").alias("wb"))
    flips = (F.col("ua") > F.col("ub")) != (F.col("wa") > F.col("wb"))
    return s.select("lang", S.r6("ua").alias("mean_a"), S.r6("ub").alias("mean_b"), S.r6("wa").alias("weighted_a"),
                    S.r6("wb").alias("weighted_b"), flips.alias("flips"))


@query("n06_sign_test", "scores", PAIRS + """, s AS (SELECT lang, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta <> 0) AS n
    FROM d GROUP BY 1)
    SELECT lang, wins, n AS n_nonzero, round(least(1.0, 2.0 * (SELECT sum(factorial(n::INT) / (factorial(i::INT) * factorial((n - i)::INT)))::DOUBLE
    FROM range(0, least(wins, n - wins) + 1) t(i)) / 2 ** n), 6) AS p_sign FROM s""")
def sign_test(spark, root):
    return M.sign_test(pairs(spark, root), ["lang"]).withColumn("p_sign", S.r6("p_sign"))


@query("n06_wilcoxon", "scores", PAIRS + """, r AS MATERIALIZED (SELECT lang, delta, CAST(2 * rank() OVER (PARTITION BY lang ORDER BY abs(delta)) + count(*) OVER (PARTITION BY lang, abs(delta)) - 1 AS BIGINT) AS r2,
    row_number() OVER (PARTITION BY lang ORDER BY abs(delta), image_id) AS i FROM d WHERE delta <> 0),
    s AS (SELECT lang, count(*) AS n, CAST(sum(CASE WHEN delta > 0 THEN r2 ELSE 0 END) AS BIGINT) AS plus, CAST(sum(r2) AS BIGINT) AS total FROM r GROUP BY 1),
    dist AS (SELECT DISTINCT lang, 0::BIGINT AS i, 0::BIGINT AS t, 1.0::DOUBLE AS c FROM r UNION ALL SELECT lang, i, t, sum(c) FROM (
    SELECT r.lang, r.i, t, c / 2 AS c FROM dist JOIN r ON r.lang = dist.lang AND r.i = dist.i + 1 UNION ALL
    SELECT r.lang, r.i, t + r2, c / 2 FROM dist JOIN r ON r.lang = dist.lang AND r.i = dist.i + 1) GROUP BY 1, 2, 3)
    SELECT lang, n, least(plus, total - plus) / 2 AS statistic, round(least(1.0, 2.0 * (SELECT sum(c) FROM dist WHERE dist.lang = s.lang AND i = n
    AND t <= least(plus, total - plus))), 6) AS p_wilcoxon, 'exact' AS method FROM s""")
def wilcoxon(spark, root):
    return M.wilcoxon(pairs(spark, root), ["lang"]).withColumn("p_wilcoxon", S.r6("p_wilcoxon"))


@query("n07_paired_t", "scores", PAIRS + """ SELECT lang, round(avg(delta), 6) AS mean_delta, round(stddev_samp(delta), 6) AS sd_delta,
    count(*) AS n, round(stddev_samp(delta) / sqrt(count(*)), 6) AS se, round(avg(delta) / (stddev_samp(delta) / sqrt(count(*))), 6) AS t
    FROM d GROUP BY 1""")
def paired_t(spark, root):
    out = M.paired_summary(pairs(spark, root), ["lang"])
    return out.withColumns({c: S.r6(c) for c in ("mean_delta", "sd_delta", "se", "t")})


@query("n08_clean_false_positives", "scores", """, f AS (SELECT image_id, avg(CAST(pa > 0.5 AS INT)) AS a, avg(CAST(pb > 0.5 AS INT)) AS b,
    bool_and(pb > 0.01) AS complete FROM scores WHERE contains(lower(image_id), 'src1') OR contains(lower(image_id), 'src7') GROUP BY 1)
    SELECT image_id, round(a, 6) AS area_a, CASE WHEN complete THEN round(b, 6) END AS area_b FROM f""")
def clean_false_positives(spark, root):
    s = T.scores(spark, root).filter(S.contains_any(F.col("image_id"), ("SRC1", "src7")))
    area = lambda m: S.r6(F.avg((F.col(m) > 0.5).cast("int")))
    return s.groupBy("image_id").agg(area("pa").alias("area_a"), F.when(F.bool_and(F.col("pb") > 0.01), area("pb")).alias("area_b"))


@query("n09_parity", "scores", """SELECT image_id, round(avg(CAST(pa > 0.5 AS INT)), 6) AS predicted, round(avg(CAST(is_pos AS INT)), 6)
    AS actual FROM scores GROUP BY 1""")
def parity(spark, root):
    return T.scores(spark, root).groupBy("image_id").agg(
        S.r6(F.avg((F.col("pa") > 0.5).cast("int"))).alias("predicted"), S.r6(F.avg(F.col("is_pos").cast("int"))).alias("actual"))


@query("n10_changed_fraction", "scores judged", """SELECT image_id, round(avg(CAST((pa > 0.5) <> (pb > 0.5) AS INT)), 6) AS changed,
    round(avg(CAST((pa > 0.5) = (state = 1) AS INT)), 6) AS agree_a, round(avg(CAST((pb > 0.5) = (state = 1) AS INT)), 6) AS agree_b
    FROM judged JOIN scores USING (image_id, y, x) GROUP BY 1""")
def changed_fraction(spark, root):
    j = T.judged(spark, root).join(T.scores(spark, root).select(*L.PIXEL, "pa", "pb"), L.PIXEL)
    a, b, t = F.col("pa") > 0.5, F.col("pb") > 0.5, F.col("state") == 1
    share = lambda c: S.r6(F.avg(c.cast("int")))
    return j.groupBy("image_id").agg(share(a != b).alias("changed"), share(a == t).alias("agree_a"), share(b == t).alias("agree_b"))


@query("l08_ensemble_fusion", "scores", """, f AS (SELECT is_pos, (pa + pb) / 2 AS pm, greatest(pa, pb) AS px, least(pa, pb) AS pn FROM scores)
    SELECT round(count(*) FILTER (pm > 0.5 AND is_pos) / count(*) FILTER (pm > 0.5 OR is_pos), 6) AS iou_mean,
    round(count(*) FILTER (px > 0.5 AND is_pos) / count(*) FILTER (px > 0.5 OR is_pos), 6) AS iou_max,
    round(count(*) FILTER (pn > 0.5 AND is_pos) / count(*) FILTER (pn > 0.5 OR is_pos), 6) AS iou_min FROM f""")
def ensemble_fusion(spark, root):
    def fused(p):
        hit = p > 0.5
        return S.r6(F.count_if(hit & F.col("is_pos")) / F.count_if(hit | F.col("is_pos")))

    a, b = F.col("pa"), F.col("pb")
    return T.scores(spark, root).agg(fused((a + b) / 2).alias("iou_mean"), fused(F.greatest(a, b)).alias("iou_max"),
                                     fused(F.least(a, b)).alias("iou_min"))


@query("l17_model_routing", "scores", """, r AS (SELECT lang, avg(((pa > 0.5) = is_pos)::INT) AS a, avg(((pb > 0.5) = is_pos)::INT) AS b FROM scores GROUP BY 1)
    SELECT image_id, y, x, round(CASE WHEN a > b THEN pa WHEN b > a THEN pb ELSE (pa + pb) / 2 END, 6) AS p FROM scores JOIN r USING (lang)""")
def model_routing(spark, root):
    """Each group is read by the model that agrees more with its truth; a routing table of one row per group says which."""
    s = T.scores(spark, root)
    right = lambda p: F.avg(((F.col(p) > 0.5) == F.col("is_pos")).cast("int"))
    score = s.groupBy("lang").agg(right("pa").alias("a"), right("pb").alias("b"))
    routes = score.select("lang", F.when(F.col("a") > F.col("b"), "a").when(F.col("b") > F.col("a"), "b").otherwise("mean").alias("use"))
    p = F.when(F.col("use") == "a", F.col("pa")).when(F.col("use") == "b", F.col("pb")).otherwise((F.col("pa") + F.col("pb")) / 2)
    return s.join(routes, "lang").select(*L.PIXEL, S.r6(p).alias("p"))


@query("l01_standardise", "rows", """, s AS (SELECT avg(f1) AS m1, stddev_pop(f1) AS s1, avg(f2) AS m2, stddev_pop(f2) AS s2 FROM rows_)
    SELECT row_key, round((f1 - m1) / s1, 6) AS z1, round((f2 - m2) / s2, 6) AS z2 FROM rows_, s""")
def standardise_query(spark, root):
    z = standardise(T.rows(spark, root), ["f1", "f2"])
    return z.select("row_key", S.r6("f1").alias("z1"), S.r6("f2").alias("z2"))


def standardise(df, columns):
    """Population-deviation scaling; constant columns keep a divisor of one."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    one = lambda n: stats.select(n).scalar()
    return df.withColumns({c: (F.col(c) - one(f"_m_{c}")) / F.when(one(f"_s_{c}") > 0, one(f"_s_{c}")).otherwise(1.0) for c in columns})
