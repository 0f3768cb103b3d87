"""Aggregate queries."""

from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.operators import aggregates as A
from rasterloom.operators import labels as L
from rasterloom.operators.quantiles import exact_percentiles
from rasterloom.plans.registry import query
from rasterloom.sources import tables as T


@query("f01_label_counts", "judged", """SELECT image_id, count(*) FILTER (state = 1) AS n_pos,
    count(*) FILTER (state = 2) AS n_neg FROM judged GROUP BY 1""")
def label_counts(spark, root):
    return L.label_counts(T.judged(spark, root))


@query("f03_group_summary", "scores", """, fr AS (SELECT lang, image_id, avg(CAST(pa > 0.5 AS INT)) AS area,
    count(*) FILTER (pa > 0.5) AS n FROM scores GROUP BY 1, 2)
    SELECT lang, count(*) AS n_frames, round(quantile_cont(area, 0.5), 6) AS median_area, round(min(area), 6) AS min_area,
    round(max(area), 6) AS max_area, round(quantile_cont(n, 0.5), 6) AS median_regions FROM fr GROUP BY 1""")
def group_summary(spark, root):
    fr = T.scores(spark, root).groupBy("lang", "image_id").agg(
        F.avg((F.col("pa") > 0.5).cast("int")).alias("area"), F.count_if(F.col("pa") > 0.5).alias("n"))
    area = exact_percentiles(fr, ["lang"], "area", {"median_area": 0.5, "min_area": 0.0, "max_area": 1.0})
    n = exact_percentiles(fr, ["lang"], "n", {"median_regions": 0.5})
    count = fr.groupBy("lang").agg(F.count(F.lit(1)).alias("n_frames"))
    return count.join(area, "lang").join(n, "lang").select(
        "lang", "n_frames", *[S.r6(c).alias(c) for c in ("median_area", "min_area", "max_area", "median_regions")])


@query("f04_confusion_counts", "scores", """SELECT lang, count(*) FILTER (pa > 0.5 AND is_pos) AS tp,
    count(*) FILTER (pa > 0.5 AND NOT is_pos) AS fp, count(*) FILTER (pa <= 0.5 AND is_pos) AS fn,
    count(*) FILTER (pa <= 0.5 AND NOT is_pos) AS tn FROM scores GROUP BY ROLLUP (lang)""")
def confusion_counts(spark, root):
    per = A.confusion(T.scores(spark, root), ["lang"], F.col("pa") > 0.5, F.col("is_pos"))
    return per.rollup("lang").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


@query("f05_coverage_histogram", "live", """, fr AS (SELECT doc_id // 4 AS image_id, count(*) AS n FROM documents GROUP BY 1),
    c AS (SELECT image_id, count(*) AS j FROM live GROUP BY 1),
    b AS (SELECT coalesce(j, 0) / n AS f FROM fr LEFT JOIN c USING (image_id))
    SELECT CASE WHEN f >= 0.95 THEN 'dense' WHEN f < 0.01 THEN 'untouched' ELSE 'partial' END AS band, count(*) AS n_frames
    FROM b GROUP BY 1""")
def coverage_histogram(spark, root):
    fr = T.table(spark, root, "documents").groupBy(F.floor(F.col("doc_id") / 4).cast("long").alias("image_id")).count()
    c = T.live_labels(spark, root).groupBy("image_id").agg(F.count(F.lit(1)).alias("j"))
    frac = F.coalesce("j", F.lit(0)) / F.col("count")
    return fr.join(c, "image_id", "left").groupBy(L.coverage_band(frac).alias("band")).agg(F.count(F.lit(1)).alias("n_frames"))


@query("f06_markup_status", "live", """, fr AS (SELECT doc_id // 4 AS image_id, min(source) AS grp FROM documents GROUP BY 1),
    c AS (SELECT image_id, count(*) FILTER (state = 1) AS p, count(*) FILTER (state = 2) AS n FROM live GROUP BY 1),
    s AS (SELECT grp, CASE WHEN p > 0 THEN 'H' WHEN n > 0 THEN 'N' ELSE 'U' END AS st FROM fr LEFT JOIN c USING (image_id))
    SELECT grp, count(*) AS n_frames, count(*) FILTER (st = 'H') AS hand_marked, count(*) FILTER (st = 'N') AS neg_only,
    count(*) FILTER (st = 'U') AS untouched FROM s GROUP BY ROLLUP (grp)""")
def markup_status(spark, root):
    fr = T.table(spark, root, "documents").groupBy(
        F.floor(F.col("doc_id") / 4).cast("long").alias("image_id")).agg(F.min("source").alias("grp"))
    st = L.markup_state(F.coalesce("n_pos", F.lit(0)), F.coalesce("n_neg", F.lit(0)))
    j = fr.join(L.label_counts(T.live_labels(spark, root)), "image_id", "left")
    per = j.groupBy("grp", st.alias("st")).agg(F.count(F.lit(1)).alias("c"))
    pick = lambda s: F.sum(F.when(F.col("st") == s, F.col("c")).otherwise(0))
    return per.rollup("grp").agg(F.sum("c").alias("n_frames"), pick("HAND_MARKED").alias("hand_marked"),
                                 pick("NEG_ONLY").alias("neg_only"), pick("UNTOUCHED").alias("untouched"))


@query("f07_run_summary", "history", """, cell AS (SELECT status, recipe, model, sum(iou) AS s, count(*) AS n,
    CASE WHEN count(*) > 1 THEN stddev_samp(iou) END AS sd FROM history GROUP BY 1, 2, 3)
    SELECT status, recipe, CAST(sum(n) AS BIGINT) AS n_runs, round(sum(s) / sum(n), 6) AS mean_iou, round(avg(sd), 6) AS noise
    FROM cell GROUP BY GROUPING SETS ((status, recipe), (status), ())""")
def run_summary(spark, root):
    cell = T.history(spark, root).groupBy("status", "recipe", "model").agg(
        F.sum("iou").alias("s"), F.count(F.lit(1)).alias("n"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp("iou")).alias("sd"))
    out = cell.groupingSets([["status", "recipe"], ["status"], []], "status", "recipe").agg(
        F.sum("n").alias("n_runs"), (F.sum("s") / F.sum("n")).alias("mean_iou"), F.avg("sd").alias("noise"))
    return out.select("status", "recipe", "n_runs", S.r6("mean_iou").alias("mean_iou"), S.r6("noise").alias("noise"))


OTSU = """, span AS (SELECT {k}, min({v}) AS lo, max({v}) AS hi FROM {t} GROUP BY 1),
    hist AS (SELECT {k}, CASE WHEN hi > lo THEN least(floor(({v} - lo) / (hi - lo) * 256), 255) ELSE 0 END AS bin,
    count(*) AS c, any_value(lo) AS lo, any_value(hi) AS hi FROM {t} JOIN span USING ({k}) GROUP BY 1, 2),
    cen AS (SELECT *, lo + (bin + 0.5) * (hi - lo) / 256 AS centre FROM hist),
    cum AS (SELECT *, sum(c) OVER u AS w1, sum(c * centre) OVER u AS m1, sum(c) OVER a AS w, sum(c * centre) OVER a AS m,
    count(*) OVER a AS nb FROM cen WINDOW u AS (PARTITION BY {k} ORDER BY bin), a AS (PARTITION BY {k})),
    var AS (SELECT *, CASE WHEN w > w1 THEN round(w1::DOUBLE * (w - w1)::DOUBLE * (m1 / w1 - (m - m1) / (w - w1)) ** 2, 9)
    ELSE -1 END AS var FROM cum),
    otsu AS (SELECT {k}, threshold FROM (SELECT {k}, CASE WHEN nb = 1 THEN lo ELSE centre END AS threshold,
    row_number() OVER (PARTITION BY {k} ORDER BY var DESC, bin) AS rn FROM var) WHERE rn = 1)"""


@query("f08_otsu", "px8", OTSU.format(k="image_id", v="v", t="px8") + """
    SELECT image_id, round(threshold, 6) AS threshold FROM otsu""")
def otsu(spark, root):
    return A.otsu(T.px8(spark, root), ["image_id"], "v").select("image_id", S.r6("threshold").alias("threshold"))


@query("f08_otsu_large_frames", "grid", OTSU.format(k="image_id", v="s", t="grid") + """
    SELECT image_id, round(threshold, 6) AS threshold FROM otsu""")
def otsu_large_frames(spark, root):
    return A.otsu(T.grid(spark, root), ["image_id"], "s").select("image_id", S.r6("threshold").alias("threshold"))


@query("f09_median_mad_threshold", "px8", OTSU.format(k="image_id", v="v", t="px8") + """,
    med AS (SELECT image_id, quantile_cont(v, 0.5) AS median FROM px8 GROUP BY 1),
    mad AS (SELECT image_id, quantile_cont(abs(v - median), 0.5) AS mad FROM px8 JOIN med USING (image_id) GROUP BY 1),
    th AS (SELECT image_id, least(threshold, median - mad * (2.0 * 1.4826)) AS th FROM otsu JOIN med USING (image_id)
    JOIN mad USING (image_id))
    SELECT image_id, round(any_value(th), 6) AS threshold, count(*) FILTER (v < th OR v < -0.3) AS n_dark
    FROM px8 JOIN th USING (image_id) GROUP BY 1""")
def median_mad_threshold(spark, root):
    px = T.px8(spark, root)
    th = A.dark_threshold(px, ["image_id"], "v", mad_k=2.0, bounded=True).select("image_id", "threshold")
    return px.join(th, "image_id").groupBy("image_id").agg(
        S.r6(F.first("threshold")).alias("threshold"),
        F.count_if((F.col("v") < F.col("threshold")) | (F.col("v") < -0.3)).alias("n_dark"))


@query("f10_flatfield_qc", "px8", """, b AS (SELECT image_id, 0.75 + v * 0.6 AS u FROM px8),
    q AS (SELECT image_id, count(*) AS n_body, quantile_cont(u, 0.25) AS a, quantile_cont(u, 0.5) AS b,
    quantile_cont(u, 0.75) AS c FROM b WHERE u > 0.7 GROUP BY 1),
    r AS (SELECT *, concat_ws('; ', CASE WHEN c - a > 0.09 THEN 'iqr' END, CASE WHEN b < 0.80 THEN 'dark' END) AS rs FROM q)
    SELECT image_id, n_body, CASE WHEN n_body >= 40 THEN round(b, 6) END AS brightness,
    CASE WHEN n_body >= 40 THEN round(c - a, 6) END AS iqr, CASE WHEN n_body < 40 THEN 'too few interior pixels'
    WHEN rs <> '' THEN rs END AS reason, n_body >= 40 AND rs = '' AS ok FROM r""")
def flatfield_qc(spark, root):
    px = T.px8(spark, root).select("image_id", (F.lit(0.75) + F.col("v") * 0.6).alias("u"))
    out = A.flatness_check(px, ["image_id"], "u", specimen_min=0.7, iqr_max=0.09, bright_min=0.80, min_pixels=40, bounded=True)
    return out.withColumns({"brightness": S.r6("brightness"), "iqr": S.r6("iqr")})


@query("f11_border_ring_density", "grid", """, f AS (SELECT image_id, max(y) + 1 AS h, 30 AS w FROM grid GROUP BY 1),
    bands AS (SELECT * FROM (VALUES (0, 5), (5, 10), (10, 15)) t(lo, hi)),
    cells AS (SELECT image_id, lo, hi, unnest(range(h)) AS y, w, h FROM f, bands),
    ring AS (SELECT image_id, lo, hi, y, x FROM (SELECT *, unnest(range(w)) AS x FROM cells) WHERE
    (y >= lo AND y < hi) OR (y >= h - hi AND y < h - lo) OR (x >= lo AND x < hi) OR (x >= w - hi AND x < w - lo)),
    d AS (SELECT r.image_id, r.lo, r.hi, avg(CAST(coalesce(g.p > 0.5, false) AS INT)) AS a,
    avg(CAST(coalesce(g.n > 1, false) AS INT)) AS b FROM ring r LEFT JOIN grid g ON g.image_id = r.image_id AND g.y = r.y
    AND g.x = r.x GROUP BY 1, 2, 3)
    SELECT image_id, concat(lo, '-', hi) AS band, round(a, 6) AS candidate, round(b, 6) AS production,
    a >= 0.03 AND a > b * 2.0 AS flagged FROM d""")
def border_ring_density(spark, root):
    g = T.grid(spark, root)
    frames = g.groupBy("image_id").agg((F.max("y") + 1).alias("height")).withColumn("width", F.lit(T.GRID_WIDTH))
    bands = [(0, 5), (5, 10), (10, 15)]
    a = A.ring_density(g.filter("p > 0.5"), frames, bands).withColumnRenamed("density", "a")
    b = A.ring_density(g.filter("n > 1"), frames, bands).withColumnRenamed("density", "b")
    return a.join(b, ["image_id", "band"]).select(
        "image_id", "band", S.r6("a").alias("candidate"), S.r6("b").alias("production"),
        ((F.col("a") >= 0.03) & (F.col("a") > F.col("b") * 2.0)).alias("flagged"))


@query("f12_raster_similarity", "px8", """, j AS (SELECT a.image_id, a.v, b.v AS u FROM px8 a JOIN px8 b
    ON a.image_id = b.image_id AND a.y = b.x AND a.x = b.y),
    s AS (SELECT image_id, avg(v) AS mv, stddev_pop(v) AS sv, avg(u) AS mu, stddev_pop(u) AS su, corr(v, u) AS c
    FROM j GROUP BY 1)
    SELECT image_id, round(any_value(c), 6) AS corr, round(avg(abs((v - mv) / sv - (u - mu) / su)), 6) AS mean_z_diff
    FROM j JOIN s USING (image_id) GROUP BY 1""")
def raster_similarity(spark, root):
    px = T.px8(spark, root).select("image_id", "y", "x", "v")
    flipped = px.select("image_id", F.col("x").alias("y"), F.col("y").alias("x"), "v")
    out = A.raster_similarity(px, flipped)
    return out.select("image_id", S.r6("corr").alias("corr"), S.r6("mean_z_diff").alias("mean_z_diff"))


@query("f13_distinct_counts", "scores", """SELECT lang, count(DISTINCT image_id) AS n_images, count(DISTINCT n_chars) AS n_sizes
    FROM scores GROUP BY 1""")
def distinct_counts(spark, root):
    return T.scores(spark, root).groupBy("lang").agg(
        F.countDistinct("image_id").alias("n_images"), F.countDistinct("n_chars").alias("n_sizes"))


@query("f15_label_gain", "judged scores", """SELECT image_id, count(*) AS n_pos, round(avg(CAST(pa > 0.5 AS INT)), 6)
    AS confirmation_share FROM judged LEFT JOIN scores USING (image_id, y, x) WHERE state = 1 GROUP BY 1""")
def label_gain(spark, root):
    pos = T.judged(spark, root).filter("state = 1")
    j = pos.join(T.scores(spark, root).select(*L.PIXEL, "pa"), L.PIXEL, "left")
    return j.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_pos"),
                                     S.r6(F.avg((F.col("pa") > 0.5).cast("int"))).alias("confirmation_share"))
