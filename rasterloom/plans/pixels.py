"""Pixel-local queries: normalisation, display windows, masks, names and overlays."""

from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.operators import pixels as P
from rasterloom.plans.registry import query
from rasterloom.sources import tables as T

LIMITS = """, lim AS (SELECT image_id, quantile_cont(v, {lo}) AS lo, quantile_cont(v, {hi}) AS hi, min(v) AS mn,
    max(v) AS mx FROM px8 GROUP BY image_id),
    win AS (SELECT image_id, CASE WHEN hi <= lo THEN mn ELSE lo END AS lo, CASE WHEN hi <= lo THEN mx ELSE hi END AS hi
    FROM lim)"""
STRETCH = "least(greatest((v - lo) / greatest(hi - lo, 1e-8), 0.0), 1.0)"


@query("b01_robust_normalize", "px8", LIMITS.format(lo=0.01, hi=0.99) + f"""
    SELECT image_id, y, x, round({STRETCH}, 6) AS v FROM px8 JOIN win USING (image_id)""")
def robust_normalize(spark, root):
    px = P.tile_pixels(P.normalize_tiles(T.px8_tiles(spark, root)))
    return px.select(F.col("image_id").cast("long").alias("image_id"), "y", "x", S.r6("v").alias("v"))


@query("b01_robust_normalize_large_frames", "grid", """, lim AS (SELECT image_id, quantile_cont(s, 0.01) AS lo,
    quantile_cont(s, 0.99) AS hi FROM grid GROUP BY 1)
    SELECT image_id, y, x, round(least(greatest((s - lo) / greatest(hi - lo, 1e-8), 0.0), 1.0), 6) AS v
    FROM grid JOIN lim USING (image_id)""")
def robust_normalize_large_frames(spark, root):
    g = T.grid(spark, root).select("image_id", "y", "x", F.col("s").alias("v"))
    return P.normalize_rows(g).select("image_id", "y", "x", S.r6("v").alias("v"))


@query("b02_display_limits", "grid", """, sup AS (SELECT image_id, count(*) FILTER (s > 40) AS n_support,
    quantile_cont(p, 0.01) FILTER (s > 40) AS s_lo, quantile_cont(p, 0.99) FILTER (s > 40) AS s_hi,
    quantile_cont(p, 0.01) AS w_lo, quantile_cont(p, 0.99) AS w_hi FROM grid GROUP BY 1),
    sel AS (SELECT image_id, n_support, CASE WHEN n_support >= 800 THEN s_lo ELSE w_lo END AS lo,
    CASE WHEN n_support >= 800 THEN s_hi ELSE w_hi END AS hi FROM sup)
    SELECT image_id, n_support, round(CASE WHEN hi - lo < 1e-4 THEN 0.0 ELSE lo END, 6) AS lo,
    round(CASE WHEN hi - lo < 1e-4 THEN 1.0 ELSE hi END, 6) AS hi FROM sel""")
def display_limits(spark, root):
    g = T.grid(spark, root)
    out = P.display_limits(g, F.col("s") > 40, "p", min_pixels=800)
    return out.select("image_id", "n_support", S.r6("lo").alias("lo"), S.r6("hi").alias("hi"))


@query("b03_common_window", "grid", """, live AS (SELECT * FROM grid WHERE s <> 0),
    win AS (SELECT quantile_cont(s, 0.01) AS lo, quantile_cont(s, 0.99) AS hi FROM live)
    SELECT image_id, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi,
    round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.75) - quantile_cont(s, 0.25), 6) AS iqr,
    round(avg(CAST(s < lo OR s > hi AS INT)), 6) AS clipped FROM live, win GROUP BY image_id""")
def common_window(spark, root):
    g = T.grid(spark, root)
    out = P.common_window(g, "s")
    return out.select("image_id", *[S.r6(c).alias(c) for c in ("lo", "hi", "median", "iqr", "clipped")])


@query("b04_to8", "px8", """SELECT image_id, y, x,
    CAST(floor(least(greatest((v + 0.3) / (0.6 + 1e-9), 0.0), 1.0) * 255) AS INT) AS v8 FROM px8""")
def to8(spark, root):
    return T.px8(spark, root).select("image_id", "y", "x", S.to_byte(F.col("v"), -0.3, 0.3).alias("v8"))


@query("b05_stretch_u8", "px8", LIMITS.format(lo=0.01, hi=0.995) + f"""
    SELECT image_id, y, x, CAST(floor({STRETCH} * 255) AS INT) AS v8 FROM px8 JOIN win USING (image_id)""")
def stretch_u8(spark, root):
    px = P.tile_pixels(P.normalize_tiles(T.px8_tiles(spark, root), 0.01, 0.995))
    return px.select(F.col("image_id").cast("long").alias("image_id"), "y", "x",
                     F.floor(F.col("v") * 255).cast("int").alias("v8"))


@query("b06_threshold", "grid", "SELECT image_id, y, x FROM grid WHERE p > 0.5")
def threshold(spark, root):
    return T.grid(spark, root).filter("p > 0.5").select("image_id", "y", "x")


@query("b08_corrected_truth", "scores judged", """SELECT image_id, y, x,
    CASE WHEN state = 1 THEN true WHEN state = 2 THEN false ELSE coalesce(is_pos, false) END AS is_pos
    FROM scores FULL JOIN judged USING (image_id, y, x)""")
def corrected_truth(spark, root):
    return P.overlay(T.scores(spark, root), T.judged(spark, root))


def group_of(name):
    """Specimen group from the file name; the first matching rule wins."""
    n = F.lower(name)
    return (F.when(n.contains("wrought"), "wrought").when(n.contains("hc_316l"), "AM/HC")
            .when(n.contains("b3_"), "B3").otherwise("B2"))


def import_group_of(name):
    """The import variant: the date only qualifies the second of the two B2 patterns."""
    n = F.lower(name)
    return (F.when(n.contains("_b2_") | (n.contains("b2_") & n.contains("260618")), "B2")
            .when(n.contains("_b3_"), "B3").when(n.contains("wrought"), "Wrought")
            .when(n.contains("hc_316l"), "AM/HC").otherwise("other"))


NAMES_SQL = """names AS (SELECT p_partkey, concat(CASE p_partkey % 5 WHEN 0 THEN 'Mosaic_260618b2_' WHEN 1 THEN 'x_B3_'
    WHEN 2 THEN 'Wrought_' WHEN 3 THEN 'HC_316L_' ELSE 'plain_b2_' END, p_name, '_', p_size, '.tif') AS name FROM part)"""


def specimen_names(spark, root):
    prefix = F.element_at(F.array(*[F.lit(s) for s in ("Mosaic_260618b2_", "x_B3_", "Wrought_", "HC_316L_", "plain_b2_")]),
                          (F.col("p_partkey") % 5 + 1).cast("int"))
    return T.table(spark, root, "part").select(
        "p_partkey", F.concat(prefix, "p_name", F.lit("_"), "p_size", F.lit(".tif")).alias("name"))


@query("b09_group_of", None, f"""WITH {NAMES_SQL} SELECT p_partkey,
    CASE WHEN lower(name) LIKE '%wrought%' THEN 'wrought' WHEN contains(lower(name), 'hc_316l') THEN 'AM/HC'
    WHEN contains(lower(name), 'b3_') THEN 'B3' ELSE 'B2' END AS grp,
    CASE WHEN contains(lower(name), '_b2_') OR (contains(lower(name), 'b2_') AND contains(name, '260618')) THEN 'B2'
    WHEN contains(lower(name), '_b3_') THEN 'B3' WHEN contains(lower(name), 'wrought') THEN 'Wrought'
    WHEN contains(lower(name), 'hc_316l') THEN 'AM/HC' ELSE 'other' END AS import_grp FROM names""")
def group_of_query(spark, root):
    names = specimen_names(spark, root)
    return names.select("p_partkey", group_of(F.col("name")).alias("grp"),
                        import_group_of(F.col("name")).alias("import_grp"))


@query("b10_name_flags", None, f"""WITH {NAMES_SQL} SELECT p_partkey,
    contains(lower(name), 'red') OR contains(lower(name), 'ring_1') AS is_clean,
    contains(name, '_1') OR contains(name, 'B3') AS is_control FROM names""")
def name_flags(spark, root):
    names = specimen_names(spark, root)
    return names.select("p_partkey", S.contains_any(F.col("name"), ("RED", "Ring_1")).alias("is_clean"),
                        S.contains_any(F.col("name"), ("_1", "B3"), ignore_case=False).alias("is_control"))


@query("b11_slug_and_id", None, r"""WITH s AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^.*/', ''),
    '(.)\.[^.]*$', '\1') AS st, html FROM pages),
    k AS (SELECT *, substr(regexp_replace(st, '[^\p{L}\p{N}_-]', '_', 'g'), 1, 80) AS kept FROM s),
    g AS (SELECT *, CASE WHEN kept = '' THEN 'image' ELSE kept END AS slug FROM k)
    SELECT page_id, slug, concat(slug, '__', substr(sha1(html), 1, 8)) AS ident,
    regexp_matches(concat(slug, '__', substr(sha1(html), 1, 8)), '^[A-Za-z0-9][A-Za-z0-9._-]{0,160}$') AS ok,
    regexp_matches(url, '^[A-Za-z0-9][A-Za-z0-9._-]{0,160}$') AND NOT contains(url, '..') AS raw_ok FROM g""")
def slug_and_id(spark, root):
    p = T.table(spark, root, "pages")
    ident = S.content_id(F.col("url"), F.col("html"))
    return p.select("page_id", S.slug(F.col("url")).alias("slug"), ident.alias("ident"),
                    S.valid_id(ident).alias("ok"), S.valid_id(F.col("url")).alias("raw_ok"))


@query("b12_soft_knee", "px8", """, r AS (SELECT image_id, y, x, exp(v * 6) AS ratio, v FROM px8),
    c AS (SELECT *, ln(least(greatest(ratio, 0.1), 10.0)) AS lr FROM r),
    w AS (SELECT *, least(greatest((abs(lr) - ln(1.1)) / (ln(1.8) - ln(1.1)), 0.0), 1.0) AS t,
    least(greatest(v + 0.5, 0.0), 1.0) AS u FROM c)
    SELECT image_id, y, x, round(u * u * (3 - 2 * u), 6) AS smooth,
    round(least(greatest(exp(t * t * (3 - 2 * t) * lr), 0.1), 10.0), 6) AS factor FROM w""")
def soft_knee(spark, root):
    px = T.px8(spark, root)
    return px.select("image_id", "y", "x", S.r6(S.smoothstep(F.col("v") + 0.5)).alias("smooth"),
                     S.r6(S.soft_knee(F.exp(F.col("v") * 6), 1.1, 1.8)).alias("factor"))


@query("b13_edge_margin_weight", "px8", """, t AS (SELECT image_id, y, x,
    least(greatest(least(y, 7 - y, x, 7 - x) / 3.0, 0.0), 1.0) AS t FROM px8)
    SELECT image_id, y, x, round(1.0 - CAST(t AS DOUBLE) * t * (3 - 2 * t), 6) AS weight FROM t""")
def edge_margin_weight(spark, root):
    px = T.px8(spark, root)
    w = S.edge_margin_weight(F.col("y"), F.col("x"), F.lit(8), F.lit(8), 3)
    return px.select("image_id", "y", "x", S.r6(w).alias("weight"))


@query("b14_colour_delta_mask", "px8", """, img AS (SELECT image_id, y, x, floor((v + 0.6) * 200) AS r,
    floor((v + 0.6) * 100) AS g, 50.0 AS b FROM px8),
    tpl AS (SELECT image_id, x AS y, y AS x, r, g, b FROM img)
    SELECT a.image_id, a.y, a.x FROM img a LEFT JOIN tpl t USING (image_id, y, x)
    WHERE sqrt((a.r - 150) ** 2 + (a.g - 70) ** 2 + (a.b - 40) ** 2) < 40
    AND NOT coalesce(sqrt((t.r - 150) ** 2 + (t.g - 70) ** 2 + (t.b - 40) ** 2) < 40, false)""")
def colour_delta_mask(spark, root):
    img = T.px8(spark, root).select("image_id", "y", "x", F.floor((F.col("v") + 0.6) * 200).alias("r"),
                                    F.floor((F.col("v") + 0.6) * 100).alias("g"), F.lit(50.0).alias("b"))
    tpl = img.select("image_id", F.col("x").alias("y"), F.col("y").alias("x"), "r", "g", "b")
    return P.colour_delta(img, tpl, (150, 70, 40))


@query("b15_invert", "px8", "SELECT image_id, y, x, round(1.0 - v, 6) AS v FROM px8")
def invert(spark, root):
    return T.px8(spark, root).select("image_id", "y", "x", S.r6(F.lit(1.0) - F.col("v")).alias("v"))


@query("b16_border_blank", "grid", """, f AS (SELECT image_id, max(y) + 1 AS h FROM grid GROUP BY 1)
    SELECT image_id, y, x FROM grid JOIN f USING (image_id)
    WHERE p > 0.5 AND y >= 5 AND y < h - 5 AND x >= 5 AND x < 25""")
def border_blank(spark, root):
    g = T.grid(spark, root)
    heights = g.groupBy("image_id").agg((F.max("y") + 1).alias("h"))
    keep = S.inside_border(F.col("y"), F.col("x"), F.col("h"), F.lit(T.GRID_WIDTH), 5)
    return g.filter("p > 0.5").join(heights, "image_id").filter(keep).select("image_id", "y", "x")


@query("b17_field_of_view", "grid", """, px AS (SELECT image_id, y, x, least(255.0, s) * CASE WHEN y > 140 THEN 0.2
    ELSE 1.0 END * CASE WHEN x <= 4 THEN 0.02 ELSE 1.0 END AS v FROM grid),
    fr AS (SELECT image_id, max(y) + 1 AS h, 30 AS w FROM grid GROUP BY 1),
    sig AS (SELECT image_id, y, avg(v) AS m, stddev_pop(v) AS sd, any_value(h) AS h FROM px JOIN fr USING (image_id)
        WHERE y >= floor(h * 0.75) GROUP BY 1, 2),
    trail AS (SELECT *, max(sd) OVER w AS bs, max(m) OVER w AS bm FROM sig
        WINDOW w AS (PARTITION BY image_id ORDER BY y RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING)),
    bar AS (SELECT image_id, min(y) AS b FROM trail WHERE y - floor(h * 0.75) >= 10 AND bs > 3 AND sd < bs * 0.4
        AND m < bm * 0.85 GROUP BY 1),
    top AS (SELECT image_id, h, w, CASE WHEN h - floor(h * 0.75) >= 15 THEN coalesce(b, h) ELSE h END AS bar
        FROM fr LEFT JOIN bar USING (image_id)),
    work AS (SELECT image_id, y, x, v FROM px JOIN top USING (image_id) WHERE y < bar),
    ry AS (SELECT image_id, min(y) AS y0, max(y) AS y1 FROM (SELECT image_id, y FROM work GROUP BY 1, 2
        HAVING avg(v) > 12) GROUP BY 1),
    rx AS (SELECT image_id, min(x) AS x0, max(x) AS x1 FROM (SELECT image_id, x FROM work GROUP BY 1, 2
        HAVING avg(v) > 12) GROUP BY 1),
    j AS (SELECT *, (y1 - y0) AS dy, (x1 - x0) AS dx FROM top LEFT JOIN ry USING (image_id) LEFT JOIN rx USING (image_id)),
    k AS (SELECT *, (y0 + y1) / 2.0 AS cy, (x0 + x1) / 2.0 AS cx, greatest(dy, dx) / 2.0 / sqrt(2.0) * 0.84 AS half,
        y0 IS NULL OR x0 IS NULL OR (dx > 0.97 * w AND dy > 0.97 * bar) AS whole FROM j),
    b AS (SELECT image_id, h, w, bar, CASE WHEN whole THEN 0 ELSE greatest(trunc(cx - half), 0) END AS x0,
        CASE WHEN whole THEN 0 ELSE greatest(trunc(cy - half), 0) END AS y0,
        CASE WHEN whole THEN w ELSE least(trunc(cx + half), w) END AS x1,
        CASE WHEN whole THEN bar ELSE least(trunc(cy + half), bar) END AS y1 FROM k),
    c AS (SELECT *, (x1 - x0) * (y1 - y0) < 0.2 * w * h AS small FROM b)
    SELECT image_id, CAST(bar AS INT) AS bar_top, CAST(CASE WHEN small THEN 0 ELSE x0 END AS INT) AS x0,
    CAST(CASE WHEN small THEN 0 ELSE y0 END AS INT) AS y0, CAST(CASE WHEN small THEN w ELSE x1 END AS INT) AS x1,
    CAST(CASE WHEN small THEN bar ELSE y1 END AS INT) AS y1 FROM c""")
def field_of_view(spark, root):
    g = T.grid(spark, root)
    frames = g.groupBy("image_id").agg((F.max("y") + 1).alias("height")).withColumn("width", F.lit(T.GRID_WIDTH))
    # A dark bar below and a dark margin on the left.
    shade = F.when(F.col("y") > 140, 0.2).otherwise(1.0) * F.when(F.col("x") <= 4, 0.02).otherwise(1.0)
    px = g.select("image_id", "y", "x", (F.least(F.lit(255.0), F.col("s")) * shade).alias("v"))
    return P.field_of_view(px, frames).select("image_id", *[F.col(c).cast("int").alias(c)
                                                            for c in ("bar_top", "x0", "y0", "x1", "y1")])
