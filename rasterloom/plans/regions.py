"""Connected-region queries."""

from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.operators import aggregates as A
from rasterloom.operators import clicks as K
from rasterloom.operators import composites as C
from rasterloom.operators import fragments as M
from rasterloom.operators import halo as X
from rasterloom.operators import proposals as B
from rasterloom.operators import regions as G
from rasterloom.operators import runs as R
from rasterloom.operators import shapes as H
from rasterloom.operators.components import label_runs
from rasterloom.operators.labels import label_counts
from rasterloom.operators.pixels import overlay, tile_pixels
from rasterloom.plans.registry import query
from rasterloom.session import materialize
from rasterloom.sources import tables as T

GRID_TILE = 256

FRAMES = """, frames AS (SELECT image_id, max(y) + 1 AS fh, 30 AS fw FROM grid GROUP BY 1)"""
OFFS8 = "(VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1))"
OFFS4 = "(VALUES (-1,0),(0,-1),(0,1),(1,0))"


def lab(name, src, where, conn):
    """Oracle CTEs: ``name`` has every pixel of the mask with its region's smallest packed position."""
    offs = OFFS8 if conn == 8 else OFFS4
    return f""", {name}_m AS MATERIALIZED (SELECT image_id, y, x, y::BIGINT * {T.PACK} + x AS id FROM {src} WHERE {where}),
    {name}_e AS MATERIALIZED (SELECT a.image_id, a.id AS a, b.id AS b FROM {name}_m a, {offs} o(dy, dx) JOIN {name}_m b
    ON b.image_id = a.image_id AND b.y = a.y + o.dy AND b.x = a.x + o.dx),
    {name}_r AS (SELECT image_id, id, id AS root FROM {name}_m UNION SELECT e.image_id, e.b, r.root FROM {name}_r r
    JOIN {name}_e e ON e.image_id = r.image_id AND e.a = r.id AND r.root < e.b),
    {name} AS (SELECT image_id, CAST(id // {T.PACK} AS INT) AS y, CAST(id % {T.PACK} AS INT) AS x, min(root) AS region_id
    FROM {name}_r GROUP BY ALL)"""


def grid_frames(g):
    return g.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("fh")).withColumn("fw", F.lit(T.GRID_WIDTH))


def grid_runs(spark, root, where=None):
    """Runs of the event grid's occupied cells, or of those that satisfy ``where``."""
    g = T.grid(spark, root)
    px = g.join(grid_frames(g), "image_id")
    return R.from_pixels(px if where is None else px.filter(where))


def grid_frame_table(spark, root):
    e = T.table(spark, root, "events")
    return e.groupBy(F.col("event_type").alias("image_id")).agg((F.max("user_id") + 1).cast("int").alias("fh")).withColumn(
        "fw", F.lit(T.GRID_WIDTH))


def labelled(spark, root, where=None, conn=8):
    return label_runs(grid_runs(spark, root, where), conn, tile=GRID_TILE)


@query("d01_label_components_8", "grid", lab("l", "grid", "true", 8) + " SELECT image_id, y, x, region_id FROM l")
def label_components_8(spark, root):
    return R.to_pixels(labelled(spark, root), "region_id")


@query("d01_label_components_4", "grid", lab("l", "grid", "true", 4) + " SELECT image_id, y, x, region_id FROM l")
def label_components_4(spark, root):
    return R.to_pixels(labelled(spark, root, conn=4), "region_id")


@query("d01_label_components_small_tiles", "grid", lab("l", "grid", "true", 8) + " SELECT image_id, y, x, region_id FROM l")
def label_components_small_tiles(spark, root):
    """The same over 16-cell tiles, so that most regions cross seams."""
    return R.to_pixels(label_runs(grid_runs(spark, root), 8, tile=16), "region_id")


@query("d02_remove_small", "grid", lab("l", "grid", "true", 4) + """, a AS (SELECT image_id, region_id FROM l GROUP BY 1, 2
    HAVING count(*) >= 6) SELECT image_id, y, x FROM l SEMI JOIN a USING (image_id, region_id)""")
def remove_small(spark, root):
    return R.to_pixels(G.remove_small(grid_runs(spark, root), 6, 4, tile=GRID_TILE))


PROPS = """, s AS (SELECT image_id, region_id, count(*) AS area, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1, avg(y) AS cy,
    avg(x) AS cx, round(var_pop(y), 10) AS vy, round(var_pop(x), 10) AS vx, round(covar_pop(y, x), 10) + 0.0 AS cov FROM l GROUP BY 1, 2),
    e AS (SELECT *, (vy + vx) / 2 + sqrt(((vy - vx) / 2) ** 2 + cov * cov) AS l1,
    greatest((vy + vx) / 2 - sqrt(((vy - vx) / 2) ** 2 + cov * cov), 0) AS l2 FROM s),
    props AS (SELECT image_id, region_id, area, y0, y1, x0, x1, cy, cx, 4 * sqrt(l1) AS major, 4 * sqrt(l2) AS minor,
    CASE WHEN l1 > 0 THEN sqrt(greatest(1 - l2 / l1, 0)) ELSE 0 END AS ecc, CASE WHEN vy = vx THEN CASE WHEN cov > 0 THEN pi() / 4
    ELSE -pi() / 4 END ELSE atan2(2 * cov, vy - vx) / 2 END AS orientation, area / ((y1 - y0) * (x1 - x0)) AS extent FROM e)"""


@query("d03_region_props", "grid", lab("l", "grid", "true", 8) + PROPS + """ SELECT image_id, region_id, area, y0, y1, x0, x1,
    round(cy, 4) AS cy, round(cx, 4) AS cx, round(major, 4) AS major, round(minor, 4) AS minor, round(ecc, 4) AS ecc,
    round(orientation, 4) AS orientation, round(extent, 4) AS extent FROM props""")
def region_props(spark, root):
    p = G.region_props(labelled(spark, root))
    return p.select("image_id", "region_id", "area", "y0", "y1", "x0", "x1",
                    *[F.round(c, 4).alias(c) for c in ("cy", "cx", "major", "minor", "ecc", "orientation", "extent")])


EULER = """, q AS (SELECT DISTINCT image_id, region_id, y + dy AS y, x + dx AS x FROM l, (VALUES (0,0),(0,-1),(-1,0),(-1,-1)) o(dy, dx)),
    qq AS (SELECT q.image_id, q.region_id, (a.y IS NOT NULL)::INT AS a, (b.y IS NOT NULL)::INT AS b, (c.y IS NOT NULL)::INT AS c,
    (d.y IS NOT NULL)::INT AS d FROM q LEFT JOIN l a ON a.image_id = q.image_id AND a.region_id = q.region_id AND a.y = q.y AND a.x = q.x
    LEFT JOIN l b ON b.image_id = q.image_id AND b.region_id = q.region_id AND b.y = q.y AND b.x = q.x + 1
    LEFT JOIN l c ON c.image_id = q.image_id AND c.region_id = q.region_id AND c.y = q.y + 1 AND c.x = q.x
    LEFT JOIN l d ON d.image_id = q.image_id AND d.region_id = q.region_id AND d.y = q.y + 1 AND d.x = q.x + 1),
    euler AS (SELECT image_id, region_id, CAST((count(*) FILTER (a + b + c + d = 1) - count(*) FILTER (a + b + c + d = 3)
    - 2 * count(*) FILTER (a + b + c + d = 2 AND a = d)) / 4 AS BIGINT) AS euler FROM qq GROUP BY 1, 2)"""
PERIM = """, bp AS (SELECT l.image_id, l.region_id, l.y, l.x FROM l LEFT JOIN (SELECT l.image_id, l.y, l.x, count(*) AS c FROM l,
    (VALUES (-1,0),(0,-1),(0,1),(1,0)) o(dy, dx) JOIN l n ON n.image_id = l.image_id AND n.y = l.y + o.dy AND n.x = l.x + o.dx GROUP BY 1, 2, 3) k
    USING (image_id, y, x) WHERE coalesce(c, 0) < 4),
    code AS (SELECT b.image_id, b.region_id, b.y, b.x, 1 + CAST(sum(CASE WHEN dy = 0 OR dx = 0 THEN 2 ELSE 10 END) AS INT) AS code FROM bp b,
    (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) o(dy, dx) JOIN bp n ON n.image_id = b.image_id
    AND n.region_id = b.region_id AND n.y = b.y + o.dy AND n.x = b.x + o.dx GROUP BY 1, 2, 3, 4),
    per AS (SELECT image_id, region_id, sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1.0::DOUBLE WHEN code IN (21, 33) THEN sqrt(2)
    WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS p FROM code GROUP BY 1, 2)"""


@query("d04_euler_perimeter_circularity", "grid", lab("l", "grid", "true", 8) + EULER + PERIM + """, a AS (SELECT image_id, region_id,
    count(*) AS area FROM l GROUP BY 1, 2)
    SELECT image_id, region_id, euler, round(coalesce(p, 0), 4) AS perimeter, round(least(1.0, 4 * pi() * area /
    (CASE WHEN coalesce(p, 0) > 0 THEN p ELSE 1 END) ** 2), 4) AS circularity
    FROM a JOIN euler USING (image_id, region_id) LEFT JOIN per USING (image_id, region_id)""")
def euler_perimeter_circularity(spark, root):
    lb = labelled(spark, root)
    j = G.perimeters(lb).join(G.euler_numbers(lb), G.KEY)
    return j.select("image_id", "region_id", "euler", F.round("perimeter", 4).alias("perimeter"),
                    F.round(G.circularity(F.col("area"), F.col("perimeter")), 4).alias("circularity"))


@query("d05_border_touching", "grid", FRAMES + lab("l", "grid", "true", 8) + """
    SELECT image_id, region_id, count(*) AS area FROM l JOIN frames USING (image_id) GROUP BY 1, 2
    HAVING bool_or(y = 0 OR x = 0 OR y = fh - 1 OR x = fw - 1) AND count(*) > 0.002 * any_value(fh * fw)""")
def border_touching(spark, root):
    return G.border_touching(labelled(spark, root), 0.002)


@query("d06_largest_component", "grid", lab("l", "grid", "true", 8) + """, a AS (SELECT image_id, region_id, count(*) AS area FROM l GROUP BY 1, 2)
    SELECT image_id, arg_max(region_id, (area, -region_id)) AS region_id, max(area) AS area, round(max(area) / sum(area), 6) AS dominance,
    max(area) / sum(area) >= 0.10 AS coherent FROM a GROUP BY 1""")
def largest_component(spark, root):
    out = G.largest(labelled(spark, root))
    return out.select("image_id", "region_id", "area", S.r6("dominance").alias("dominance"), (F.col("dominance") >= 0.10).alias("coherent"))


@query("d07_shape_filter", "grid", lab("l", "grid", "true", 8) + PROPS + EULER + """
    SELECT image_id, region_id, area FROM props JOIN euler USING (image_id, region_id)
    WHERE NOT (area < 40 AND euler < 1) AND NOT (area <= 30 AND round(ecc, 9) < 0.5)""")
def shape_filter(spark, root):
    return G.areas(G.shape_filter(labelled(spark, root), hole_max=40, round_max=30))


DISK3 = ", ".join(f"({dy},{dx})" for dy in range(-3, 4) for dx in range(-3, 4) if dy * dy + dx * dx <= 9)


@query("d08_validated_hysteresis", "grid", lab("l", "grid", "p > 0.6", 8) + f""", kept AS (SELECT image_id, y, x FROM l
    WHERE (image_id, region_id) IN (SELECT (image_id, region_id) FROM l GROUP BY image_id, region_id HAVING count(*) >= 3))
    SELECT image_id, y, x FROM kept UNION SELECT g.image_id, g.y, g.x FROM kept k, (VALUES {DISK3}) o(dy, dx)
    JOIN grid g ON g.image_id = k.image_id AND g.y = k.y + o.dy AND g.x = k.x + o.dx WHERE g.p >= 0.35""")
def validated_hysteresis(spark, root):
    kept = G.remove_small(grid_runs(spark, root, "p > 0.6"), 3, 8, tile=GRID_TILE)
    return R.to_pixels(G.grow_into(kept, grid_runs(spark, root, "p >= 0.35"), 3))


@query("d11_tile_phase_reject", "grid", lab("l", "grid", "true", 8) + PROPS + """, r AS (SELECT *, floor((cy % 20) / 20 * 8) AS b1,
    floor((cx % 10) / 10 * 8) AS b2 FROM props WHERE area >= 2), c AS (SELECT image_id, b1, b2, count(*) AS n FROM r GROUP BY ALL),
    t AS (SELECT image_id, sum(n) AS tot FROM c GROUP BY 1), hot AS (SELECT image_id, b1, b2 FROM c JOIN t USING (image_id)
    WHERE tot >= 12 AND n > tot / 64.0 * 2.0)
    SELECT image_id, region_id FROM r SEMI JOIN hot USING (image_id, b1, b2) WHERE round(ecc, 9) < 0.9""")
def tile_phase_reject(spark, root):
    lb = labelled(spark, root)
    props = G.region_props(lb).withColumn("ecc", F.round("ecc", 9))
    pitch = grid_frame_table(spark, root).select("image_id", F.lit(20).alias("pitch_y"), F.lit(10).alias("pitch_x"))
    return G.phase_reject(lb, props, pitch, min_area=2, excess=2.0)


@query("d12_relabel_dense", "grid", lab("l", "grid", "true", 8) + """, a AS (SELECT image_id, region_id, count(*) AS area FROM l GROUP BY 1, 2
    HAVING count(*) >= 5) SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY region_id) AS label FROM a""")
def relabel_dense(spark, root):
    return G.relabel_dense(labelled(spark, root), 5)


@query("d15_probability_of_detection", "grid", lab("l", "grid", "p > 0.4", 8) + """, h AS (SELECT l.image_id, l.region_id, count(*) AS area,
    bool_or(g.n > 1) AS hit FROM l JOIN grid g USING (image_id, y, x) GROUP BY 1, 2),
    b AS (SELECT CASE WHEN area < 2 THEN 0 WHEN area < 5 THEN 1 WHEN area < 20 THEN 2 ELSE 3 END AS bin, * FROM h)
    SELECT bin, count(*) FILTER (hit) AS found, count(*) AS total, CAST(sum(area) AS BIGINT) AS pixels,
    round(count(*) FILTER (hit) / count(*), 6) AS rate, round(sum(area) / (SELECT sum(area) FROM b), 6) AS pixel_share FROM b GROUP BY 1""")
def probability_of_detection(spark, root):
    out = G.detection_probability(labelled(spark, root, "p > 0.4"), grid_runs(spark, root, "n > 1"), (2, 5, 20))
    return out.withColumns({"rate": S.r6("rate"), "pixel_share": S.r6("pixel_share")})


@query("d16_spontaneous_regions", "grid", FRAMES + lab("l", "grid", "p > 0.5", 8) + """, h AS (SELECT l.image_id, l.region_id, count(*) AS area,
    bool_or(g.n > 1) AS hit FROM l JOIN grid g USING (image_id, y, x) GROUP BY 1, 2)
    SELECT f.image_id, CAST(coalesce(sum(area) FILTER (NOT hit), 0) AS BIGINT) AS new_area,
    round(coalesce(sum(area) FILTER (NOT hit), 0) / any_value(fh * fw), 6) AS fraction,
    coalesce(sum(area) FILTER (NOT hit), 0) / any_value(fh * fw) > 0.02 AS flagged
    FROM frames f LEFT JOIN h USING (image_id) GROUP BY 1""")
def spontaneous_regions(spark, root):
    out = G.spontaneous(grid_runs(spark, root, "p > 0.5"), grid_runs(spark, root, "n > 1"), grid_frame_table(spark, root))
    return out.withColumn("fraction", S.r6("fraction"))


FALSE_CALLS = FRAMES + lab("f", "grid", "p > 0.4", 4) + """, pr AS (SELECT image_id, y, x FROM f WHERE (image_id, region_id) IN
    (SELECT (image_id, region_id) FROM f GROUP BY image_id, region_id HAVING count(*) >= 4))""" + lab("l", "pr", "true", 8) + """,
    calls AS (SELECT fr.image_id, count(DISTINCT region_id) AS indications, round(count(l.y) / any_value(fh * fw), 6) AS area_fraction
    FROM frames fr LEFT JOIN l USING (image_id) WHERE contains(fr.image_id, 'c') OR contains(fr.image_id, 'e') GROUP BY 1)"""


def false_calls(spark, root, tile):
    clean = S.contains_any(F.col("image_id"), ("C", "E"))
    return G.false_indications(grid_runs(spark, root, F.col("p") > 0.4).filter(clean), grid_frame_table(spark, root).filter(clean), 4, tile=tile)


@query("d17_false_indications", "grid", FALSE_CALLS + " SELECT * FROM calls")
def false_indications(spark, root):
    return false_calls(spark, root, GRID_TILE)


@query("d17_false_indications_small_tiles", "grid", FALSE_CALLS + " SELECT * FROM calls")
def false_indications_small_tiles(spark, root):
    """The same over 16-cell tiles, so that most regions cross seams."""
    return false_calls(spark, root, 16)


@query("d17_false_indication_summary", "grid", FALSE_CALLS + """ SELECT count(*) AS n_frames, round(avg(area_fraction), 6) AS mean_area, max(area_fraction) AS max_area,
    round(avg(indications), 6) AS mean_indications, max(indications) AS max_indications, count(*) FILTER (indications = 0) AS n_clear FROM calls""")
def false_indication_summary(spark, root):
    out = G.false_indication_summary(false_calls(spark, root, GRID_TILE))
    return out.withColumns({"mean_area": S.r6("mean_area"), "mean_indications": S.r6("mean_indications")})


TILING = {"tile": 128, "halo": 32}


@query("d13_skeleton_stats")
def skeleton_stats(spark, root):
    lb = labelled(spark, root)
    out = G.areas(lb).join(H.skeleton_stats(H.skeleton(lb, **TILING)), G.KEY, "left")
    return out.fillna(0, ["skeleton_length", "branch_points", "endpoints"]).withColumn("tortuosity", F.round("tortuosity", 4))


@query("d14_shape_measurements")
def shape_measurements(spark, root):
    return H.shape_measurements(labelled(spark, root, "p > 0.4"), **TILING)


@query("d10_curvilinear_gate")
def curvilinear_gate(spark, root):
    return R.to_pixels(H.curvilinear(labelled(spark, root), min_area=8, min_skeleton=10, **TILING))


def grid_pixels(spark, root):
    """Occupied cells as pixels with their frame size and displayed value."""
    g = T.grid(spark, root)
    return g.join(grid_frames(g), "image_id").select("image_id", "fh", "fw", "y", "x", "p", "n", "s", F.col("p").alias("v"))


def clicks(spark, root):
    """One click per frame and day: on the strongest cell of odd days, on the weakest of even days."""
    g = T.grid(spark, root)
    pick = F.when(F.col("x") % 2 == 1, F.max_by("y", F.struct("s", "y"))).otherwise(F.min_by("y", F.struct("s", "y")))
    per = g.groupBy("image_id", "x").agg(pick.alias("y"))
    mode = F.when(F.col("x") % 3 == 0, "remove").when(F.col("x") % 3 == 1, "confirm").otherwise("toggle")
    return per.select(F.concat_ws("/", "image_id", "x").alias("click_id"), "image_id", "y", "x", mode.alias("mode"))


CLICKS = """, clicks AS (SELECT concat(image_id, '/', x) AS click_id, image_id, x, CASE WHEN x % 2 = 1 THEN arg_max(y, (s, y)) ELSE arg_min(y, (s, y)) END AS y,
    CASE x % 3 WHEN 0 THEN 'remove' WHEN 1 THEN 'confirm' ELSE 'toggle' END AS mode FROM grid GROUP BY image_id, x),
    tol AS (SELECT image_id, greatest(0.02, stddev_pop(p) * 0.75) AS tol FROM grid GROUP BY 1)"""
FLOOD = """, fm AS (SELECT c.click_id AS image_id, g.y, g.x FROM {src} c JOIN grid s ON s.image_id = c.image_id AND s.y = c.y AND s.x = c.x
    JOIN tol t ON t.image_id = c.image_id JOIN grid g ON g.image_id = c.image_id AND abs(g.p - s.p) <= tol)""" + lab("fl", "fm", "true", 8) + """,
    home AS (SELECT fl.image_id, fl.region_id FROM fl JOIN {src} c ON c.click_id = fl.image_id AND c.y = fl.y AND c.x = fl.x),
    fa AS (SELECT fl.image_id AS click_id, count(*) AS c FROM fl SEMI JOIN home USING (image_id, region_id) GROUP BY 1)"""


@query("d19_flood", "grid", CLICKS + FLOOD.format(src="clicks") + " SELECT click_id, c AS area FROM fa")
def flood(spark, root):
    px = grid_pixels(spark, root)
    runs = K.flood(clicks(spark, root), px, K.frame_tolerance(px), tile=GRID_TILE)
    return runs.groupBy(F.col("image_id").alias("click_id")).agg(F.sum(G.run_length()).alias("area"))


@query("d18_region_at_point", "grid", CLICKS + lab("l1", "grid", "p > 0.6", 8) + lab("l2", "grid", "p > 0.15", 8) + """,
    a1 AS (SELECT image_id, region_id, count(*) AS n FROM l1 GROUP BY 1, 2), a2 AS (SELECT image_id, region_id, count(*) AS n FROM l2 GROUP BY 1, 2),
    j AS (SELECT c.*, a1.n AS a, a2.n AS b FROM clicks c LEFT JOIN l1 USING (image_id, y, x) LEFT JOIN a1 ON a1.image_id = c.image_id AND a1.region_id = l1.region_id
    LEFT JOIN l2 ON l2.image_id = c.image_id AND l2.y = c.y AND l2.x = c.x LEFT JOIN a2 ON a2.image_id = c.image_id AND a2.region_id = l2.region_id),
    opn AS (SELECT * FROM j WHERE a IS NULL AND b IS NULL)""" + FLOOD.format(src="opn") + FRAMES + """,
    k AS (SELECT j.*, fa.c, fh * fw AS n, CASE WHEN a IS NOT NULL THEN 'predicted region' WHEN b IS NOT NULL THEN 'weak region' WHEN fa.c IS NOT NULL THEN 'similar values' END
    AS source, g.n >= 2 AND g.s < 60 AS neg FROM j LEFT JOIN fa USING (click_id) JOIN frames USING (image_id) JOIN grid g ON g.image_id = j.image_id AND g.y = j.y AND g.x = j.x)
    SELECT click_id, image_id, y, x, mode, source, coalesce(a, b, c) AS region_px, source = 'similar values' AND c > 0.02 * n AS refused,
    CASE WHEN source = 'similar values' AND c > 0.02 * n THEN NULL WHEN mode = 'confirm' THEN 1 WHEN mode = 'remove' THEN 2 WHEN neg THEN 1 ELSE 2 END AS new_state FROM k""")
def region_at_point(spark, root):
    px = grid_pixels(spark, root)
    labels = px.filter("n >= 2 AND s < 60").select("image_id", "y", "x", F.lit(2).alias("state"))
    return K.resolve_clicks(clicks(spark, root), px, grid_runs(spark, root, "p > 0.6"), grid_runs(spark, root, "p > 0.15"), labels,
                            max_fraction=0.02, tile=GRID_TILE)


@query("d24_near_pairs", "grid", lab("l", "grid", "p > 0.4", 8) + """, a AS (SELECT image_id, region_id FROM l GROUP BY 1, 2 HAVING count(*) >= 8),
    k AS (SELECT l.* FROM l SEMI JOIN a USING (image_id, region_id)),
    d AS (SELECT p.image_id, p.region_id AS u, q.region_id AS v, (p.y - q.y) ** 2 + (p.x - q.x) ** 2 AS d2 FROM k p JOIN k q ON p.image_id = q.image_id
    AND p.region_id < q.region_id AND abs(p.y - q.y) <= 8 AND abs(p.x - q.x) <= 8)
    SELECT image_id, u, v, round(sqrt(min(d2)), 6) AS gap FROM d WHERE d2 <= 64 GROUP BY ALL""")
def near_pairs(spark, root):
    lb = labelled(spark, root, "p > 0.4")
    large = G.keep_regions(lb, G.areas(lb).filter("area >= 8"))
    return M.near_pairs(large, 8).select("image_id", "u", "v", S.r6("gap").alias("gap"))


@query("d24_merge_fragments")
def merge_fragments(spark, root):
    lb = labelled(spark, root, "p > 0.4")
    px = grid_pixels(spark, root).withColumn("v", F.lit(1.0) - F.col("p"))
    groups, _ = M.merge_fragments(lb, px, min_area=8, max_gap=8, max_bridge=0.9, margin=4, fill=1.0)
    return groups


CAND = """, dark AS (SELECT l.image_id, l.region_id, avg(255 - floor(g.p * 255)) AS d FROM l JOIN grid g USING (image_id, y, x) GROUP BY 1, 2)"""


RIDGE_TILE = 64


#: Per row of a region, the widest line between any point at or above and any at or below bounds its hull.
SOLID = """, hr AS (SELECT image_id, region_id, y, min(x) AS a, max(x) AS b FROM l GROUP BY ALL),
    hp AS (SELECT image_id, region_id, 2 * y + d AS t, min(a - CASE d WHEN 0 THEN 0.5 ELSE 0 END)::DOUBLE AS a, max(b + CASE d WHEN 0 THEN 0.5 ELSE 0 END)::DOUBLE AS b
    FROM hr, (VALUES (-1), (0), (1)) v(d) GROUP BY ALL),
    hh AS (SELECT r.image_id, r.region_id, r.y, min(p.a + (q.a - p.a) * (2 * r.y - p.t) / greatest(q.t - p.t, 1)) AS a,
    max(p.b + (q.b - p.b) * (2 * r.y - p.t) / greatest(q.t - p.t, 1)) AS b FROM hr r
    JOIN hp p ON p.image_id = r.image_id AND p.region_id = r.region_id AND p.t <= 2 * r.y
    JOIN hp q ON q.image_id = r.image_id AND q.region_id = r.region_id AND q.t >= 2 * r.y GROUP BY ALL),
    hull AS (SELECT image_id, region_id, sum(floor(b + 1e-10) - ceil(a - 1e-10) + 1) AS hull_area FROM hh GROUP BY ALL)"""


@query("d25_candidate_solidity", "grid", FRAMES + lab("l", "grid", "true", 8) + PROPS + SOLID + """,
    c AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY region_id) AS label FROM props WHERE area >= 4)
    SELECT c.image_id, label, area, round(area / hull_area, 4) AS solidity FROM c JOIN hull USING (image_id, region_id)""")
def candidate_solidity(spark, root):
    """Share of its convex hull that every candidate fills."""
    lb = materialize(labelled(spark, root), "regions")
    hull = H.hull_areas(G.keep_regions(lb, G.areas(lb).filter("area >= 4")))
    p = G.region_props(lb).filter("area >= 4").join(G.relabel_dense(lb, 4).select(*G.KEY, "label"), G.KEY).join(hull, G.KEY)
    return p.select("image_id", "label", "area", F.round(F.col("area") / F.col("hull_area"), 4).alias("solidity"))


@query("d25_candidate_ridge")
def candidate_ridge(spark, root):
    """Mean ridge strength of every candidate; frames are tiled and the strength is scaled by the frame's largest."""
    lb = materialize(labelled(spark, root), "regions")
    tiles = X.tiles_from_pixels(T.grid(spark, root), grid_frame_table(spark, root), RIDGE_TILE, "p")
    strength = tile_pixels(C.ridge_response(tiles, RIDGE_TILE), ["ridge"], ["ridge"])
    mean = R.to_pixels(lb, "region_id").join(strength, ["image_id", "y", "x"]).groupBy(*G.KEY).agg(F.avg("ridge").alias("ridge"))
    label = G.relabel_dense(lb, 4).select(*G.KEY, "label")
    return mean.join(label, G.KEY).select("image_id", "label", F.round("ridge", 4).alias("mean_ridge"))


def candidates(labelled_runs, px, min_area):
    """Shape and intensity columns of every candidate region, with dense labels."""
    dark = R.to_pixels(labelled_runs, "region_id").join(px.select("image_id", "y", "x", "v8"), ["image_id", "y", "x"]).groupBy(*G.KEY).agg(
        F.avg(255 - F.col("v8")).alias("mean_darkness"))
    p = G.region_props(labelled_runs).filter(F.col("area") >= min_area)
    label = G.relabel_dense(labelled_runs, min_area).select(*G.KEY, "label")
    per = G.perimeters(labelled_runs).select(*G.KEY, "perimeter")
    j = p.join(label, G.KEY).join(dark, G.KEY).join(per, G.KEY)
    minor = F.when(F.col("minor") > 0, F.col("minor")).otherwise(0.5)
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    return j.select("image_id", "label", "area", w.alias("width"), h.alias("height"), *[F.round(c, 4).alias(c) for c in (
        "cx", "cy", "major", "minor", "ecc", "extent", "mean_darkness")], F.round(F.col("major") / minor, 3).alias("elongation"),
        F.round(G.circularity(F.col("area"), F.col("perimeter")), 4).alias("circularity"), F.round(F.log10("area"), 6).alias("log_area"),
        F.round(100.0 * F.col("area") / (F.col("fh") * F.col("fw")), 6).alias("coverage_pct"), F.round(h / w, 6).alias("hw_ratio"))


@query("d25_candidate_table", "grid", FRAMES + lab("l", "grid", "true", 8) + PROPS + PERIM + CAND + """,
    c AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY region_id) AS label FROM props WHERE area >= 4)
    SELECT c.image_id, label, area, x1 - x0 AS width, y1 - y0 AS height, round(cx, 4) AS cx, round(cy, 4) AS cy, round(major, 4) AS major, round(minor, 4) AS minor,
    round(ecc, 4) AS ecc, round(extent, 4) AS extent, round(d, 4) AS mean_darkness, round(major / CASE WHEN minor > 0 THEN minor ELSE 0.5 END, 3) AS elongation,
    round(least(1.0, 4 * pi() * area / (CASE WHEN coalesce(p, 0) > 0 THEN p ELSE 1 END) ** 2), 4) AS circularity, round(log10(area), 6) AS log_area,
    round(100.0::DOUBLE * area / (fh * fw), 6) AS coverage_pct, round((y1 - y0) / (x1 - x0), 6) AS hw_ratio
    FROM c JOIN frames USING (image_id) JOIN dark ON dark.image_id = c.image_id AND dark.region_id = c.region_id
    LEFT JOIN per ON per.image_id = c.image_id AND per.region_id = c.region_id""")
def candidate_table(spark, root):
    px = grid_pixels(spark, root).withColumn("v8", F.floor(F.col("p") * 255))
    return candidates(labelled(spark, root), px, 4)


@query("d26_top_boxes", "grid", lab("l", "grid", "true", 8) + PROPS + """ SELECT image_id, region_id, area, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER
    (PARTITION BY image_id ORDER BY area DESC, region_id) AS rn FROM props WHERE area >= 10) WHERE rn <= 8""")
def top_boxes(spark, root):
    return B.top_boxes(G.region_props(labelled(spark, root)), k=8, min_area=10)


@query("d26_region_points", "grid", """SELECT image_id, y, x FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY
    md5(concat_ws(':', '0', image_id, y, x))) AS rn FROM grid WHERE p > 0.5) WHERE rn <= 32""")
def region_points(spark, root):
    return B.sampled_points(T.grid(spark, root).filter("p > 0.5"), 32, 0)


@query("d26_grid_points", "grid", FRAMES + """ SELECT image_id, round(4 + i * (fh - 1 - 8) / 31.0::DOUBLE, 6) AS y, round(4 + j * (fw - 1 - 8) / 31.0::DOUBLE, 6) AS x
    FROM frames, range(32) a(i), range(32) b(j)""")
def grid_points(spark, root):
    return B.grid_points(grid_frame_table(spark, root), 32, 4).withColumns({"y": S.r6("y"), "x": S.r6("x")})


PROPOSALS = """, pr AS (SELECT image_id, concat(t, '/', y // 12) AS proposal, y, x FROM grid, (VALUES (1), (2), (3)) v(t) WHERE p > 0.2 * t + 0.1)"""


def proposals(spark, root):
    g = T.grid(spark, root).withColumn("t", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).filter(F.col("p") > F.col("t") * 0.2 + 0.1)
    return g.select("image_id", F.concat_ws("/", "t", F.floor(F.col("y") / 12)).alias("proposal"), "y", "x")


@query("d27_select_by_darkness", "grid", FRAMES + PROPOSALS + """, q AS (SELECT image_id, quantile_cont(1 - p, 0.3) AS q FROM grid GROUP BY 1),
    a AS (SELECT image_id, proposal, avg(1 - p) AS m, count(*) AS n FROM pr JOIN grid USING (image_id, y, x) GROUP BY 1, 2),
    k AS (SELECT image_id, proposal FROM a JOIN q USING (image_id) JOIN frames USING (image_id) WHERE m < q AND n <= 0.02 * fh * fw)
    SELECT DISTINCT image_id, y, x FROM pr SEMI JOIN k USING (image_id, proposal)""")
def select_by_darkness(spark, root):
    px = grid_pixels(spark, root).withColumn("v", F.lit(1.0) - F.col("p"))
    return B.select_by_darkness(proposals(spark, root), px, grid_frame_table(spark, root), 0.3, 0.02)


@query("d28_proposal_purity", "grid", PROPOSALS + """ SELECT image_id, proposal, count(*) AS area, count(*) FILTER (n > 1) AS overlap,
    round(count(*) FILTER (n > 1) / count(*), 6) AS purity FROM pr JOIN grid USING (image_id, y, x) GROUP BY 1, 2""")
def proposal_purity(spark, root):
    return B.proposal_purity(proposals(spark, root), T.grid(spark, root).filter("n > 1")).withColumn("purity", S.r6("purity"))


@query("d28_greedy_union", "grid", PROPOSALS + """, t AS (SELECT image_id, list(y * 100 + x) AS truth, count(*) AS total FROM grid WHERE n > 1 GROUP BY 1),
    p AS (SELECT image_id, proposal, list(y * 100 + x) AS cells FROM pr GROUP BY 1, 2),
    k AS MATERIALIZED (SELECT image_id, proposal, cells, coalesce(truth, []) AS truth, coalesce(total, 0) AS total, len(list_intersect(cells, coalesce(truth, []))) / len(cells) AS purity
    FROM p LEFT JOIN t USING (image_id)),
    r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY purity DESC, proposal) AS turn FROM k),
    s AS (SELECT DISTINCT image_id, 0::BIGINT AS turn, [] :: BIGINT[] AS covered, 0.0::DOUBLE AS best, [] :: VARCHAR[] AS chosen FROM r
      UNION ALL SELECT image_id, turn, CASE WHEN score > best THEN joint ELSE covered END, greatest(score, best), CASE WHEN score > best THEN list_append(chosen, proposal) ELSE chosen END
      FROM (SELECT *, hits / greatest(total + len(joint) - hits, 1) AS score FROM (SELECT *, len(list_intersect(joint, truth)) AS hits
        FROM (SELECT r.*, covered, best, chosen, list_distinct(list_concat(covered, cells)) AS joint FROM s JOIN r ON r.image_id = s.image_id AND r.turn = s.turn + 1) AS x1) AS x2) AS x3),
    g AS (SELECT image_id, arg_max(best, turn) AS best, arg_max(chosen, turn) AS chosen FROM s GROUP BY 1),
    m AS (SELECT image_id, list(proposal) AS chosen, any_value(total) AS total, any_value(truth) AS truth, list_distinct(flatten(list(cells))) AS joint FROM r WHERE purity > 0.5 GROUP BY 1),
    w AS (SELECT g.image_id, m.chosen AS major, g.chosen, g.best, len(list_intersect(joint, truth)) / greatest(total + len(joint) - len(list_intersect(joint, truth)), 1) AS score
    FROM g LEFT JOIN m USING (image_id))
    SELECT image_id, unnest(CASE WHEN score > best THEN major ELSE chosen END) AS proposal, round(CASE WHEN score > best THEN score ELSE best END, 6) AS iou FROM w""")
def greedy_union(spark, root):
    return B.greedy_union(proposals(spark, root), T.grid(spark, root).filter("n > 1")).withColumn("iou", S.r6("iou"))


STATES = "SELECT image_id, y, x, CASE WHEN n >= 3 THEN 1 ELSE 2 END AS state FROM grid WHERE n >= 3 OR (n = 2 AND s < 60)"


def grid_labels(spark, root):
    g = T.grid(spark, root).filter("n >= 3 OR (n = 2 AND s < 60)")
    return g.select("image_id", "y", "x", F.when(F.col("n") >= 3, 1).otherwise(2).alias("state"))


def effective_mask(prob_runs, labels, frames, min_area=2000, prune=True, **opts):
    """Pruned prediction with the labels on top, as runs; labels are applied last, so painted pixels never vanish."""
    base = G.remove_small(prob_runs, min_area, 4, **opts) if prune else prob_runs
    lab = labels.join(frames, "image_id")
    pos, neg = R.from_pixels(lab.filter("state = 1")), R.from_pixels(lab.filter("state = 2"))
    return R.subtract(R.union(base, pos), neg)


EFFECTIVE = lab("f", "grid", "p > 0.5", 4) + f""", pr AS (SELECT image_id, y, x FROM f WHERE (image_id, region_id) IN (SELECT (image_id, region_id) FROM f
    GROUP BY image_id, region_id HAVING count(*) >= 4)), st AS ({STATES}),
    eff AS (SELECT image_id, y, x FROM pr FULL JOIN st USING (image_id, y, x) WHERE CASE state WHEN 1 THEN true WHEN 2 THEN false ELSE true END)"""


def grid_effective(spark, root):
    return effective_mask(grid_runs(spark, root, "p > 0.5"), grid_labels(spark, root), grid_frame_table(spark, root), 4, tile=GRID_TILE)


@query("b07_effective_mask", "grid", EFFECTIVE + " SELECT image_id, y, x FROM eff")
def effective_mask_query(spark, root):
    return R.to_pixels(grid_effective(spark, root))


@query("b07_effective_mask_without_prediction", "grid", f", st AS ({STATES}) SELECT image_id, y, x FROM st WHERE state = 1")
def effective_mask_without_prediction(spark, root):
    """A frame without a prediction starts from an empty mask, so only forced pixels show."""
    none = grid_runs(spark, root, "p > 2")
    return R.to_pixels(effective_mask(none, grid_labels(spark, root), grid_frame_table(spark, root), prune=False))


def frame_counts(mask, frames, **opts):
    """Positive pixels, area fraction and 8-connected regions per frame."""
    per = label_runs(mask, 8, **opts).groupBy("image_id").agg(
        F.sum(G.run_length()).alias("positive_px"), F.countDistinct("region_id").alias("n_regions"))
    j = frames.join(per, "image_id", "left").fillna(0, ["positive_px", "n_regions"])
    return j.withColumn("area_fraction", F.round(F.col("positive_px") / (F.col("fh") * F.col("fw")), 6))


COUNTS = EFFECTIVE + lab("l", "eff", "true", 8) + FRAMES + """, cnt AS (SELECT f.image_id, fh, fw, count(l.y) AS positive_px, count(DISTINCT region_id) AS n_regions,
    round(count(l.y) / (fh * fw), 6) AS area_fraction FROM frames f LEFT JOIN l USING (image_id) GROUP BY 1, 2, 3)"""


@query("f02_frame_counts", "grid", COUNTS + " SELECT image_id, positive_px, n_regions, area_fraction FROM cnt")
def frame_counts_query(spark, root):
    out = frame_counts(grid_effective(spark, root), grid_frame_table(spark, root), tile=GRID_TILE)
    return out.select("image_id", "positive_px", "n_regions", "area_fraction")


@query("a10_export_regions", "grid", EFFECTIVE + lab("l", "eff", "true", 8) + PROPS + FRAMES + """ SELECT image_id, region_id, area AS area_px,
    round(100.0::DOUBLE * area / (fh * fw), 4) AS area_pct, round(major, 2) AS major_px, round(minor, 2) AS minor_px, round(degrees(orientation), 2) AS orientation_deg,
    round(cx, 3) AS cx, round(cy, 3) AS cy FROM props JOIN frames USING (image_id) WHERE area >= 5""")
def export_regions(spark, root):
    p = G.region_props(label_runs(grid_effective(spark, root), 8, tile=GRID_TILE)).filter("area >= 5")
    pct = F.round(100.0 * F.col("area") / (F.col("fh") * F.col("fw")), 4)
    return p.select("image_id", "region_id", F.col("area").alias("area_px"), pct.alias("area_pct"), F.round("major", 2).alias("major_px"),
                    F.round("minor", 2).alias("minor_px"), F.round(F.degrees("orientation"), 2).alias("orientation_deg"), F.round("cx", 3).alias("cx"),
                    F.round("cy", 3).alias("cy")).orderBy("image_id", F.desc("area_px"), "region_id")


@query("a10_export_measurements")
def export_measurements(spark, root):
    """The full measurement table of the effective mask, one row per region, largest first within a frame."""
    m = H.shape_measurements(label_runs(grid_effective(spark, root), 8, tile=GRID_TILE), **TILING)
    named = {"image_id": "source_image", "area": "area_px", "skeleton_length": "skeleton_length_px", "mean_width": "mean_width_px", "max_width": "max_width_px",
             "major": "major_px", "minor": "minor_px", "cx": "centroid_x_px", "cy": "centroid_y_px"}
    return m.filter("area >= 5").drop("solidity").withColumnsRenamed(named).orderBy("source_image", F.desc("area_px"), "region_id")


@query("a11_export_summary", "grid", COUNTS + """, lc AS (SELECT image_id, count(*) FILTER (state = 1) AS p, count(*) FILTER (state = 2) AS n FROM st GROUP BY 1)
    SELECT image_id, fh AS height_px, fw AS width_px, round(fh * fw / 1e6, 3) AS megapixels, positive_px, area_fraction, n_regions, coalesce(p, 0) AS corrected_pos,
    coalesce(n, 0) AS corrected_neg FROM cnt LEFT JOIN lc USING (image_id)""")
def export_summary(spark, root):
    out = frame_counts(grid_effective(spark, root), grid_frame_table(spark, root), tile=GRID_TILE)
    j = out.join(label_counts(grid_labels(spark, root)), "image_id", "left").fillna(0, ["n_pos", "n_neg"])
    return j.select("image_id", F.col("fh").alias("height_px"), F.col("fw").alias("width_px"), F.round(F.col("fh") * F.col("fw") / 1e6, 3).alias("megapixels"),
                    "positive_px", "area_fraction", "n_regions", F.col("n_pos").alias("corrected_pos"), F.col("n_neg").alias("corrected_neg"))


SCORE_SLOPE, SCORE_SHIFT = 12.0, 1.0  # of the stored logistic model on a pixel's excess over its frame's mean


@query("r06_batch_apply", "px8", f""", fr AS (SELECT image_id, any_value(grp) AS grp, avg(v) AS m FROM px8 GROUP BY 1),
    scored AS (SELECT image_id, y, x, 1 / (1 + exp({SCORE_SHIFT} - {SCORE_SLOPE} * (v - m))) AS p FROM px8 JOIN fr USING (image_id))""" + lab("f", "scored", "p > 0.5", 4) + """,
    pr AS (SELECT image_id, y, x FROM f WHERE (image_id, region_id) IN (SELECT (image_id, region_id) FROM f GROUP BY image_id, region_id HAVING count(*) >= 2)),
    hand AS (SELECT doc_id AS image_id, CAST(doc_id // 8 % 8 AS INT) AS y, CAST(doc_id % 8 AS INT) AS x, CASE WHEN toxic = 1 THEN 1 ELSE 2 END AS state
    FROM labels JOIN fr ON doc_id = image_id WHERE toxic = 1 OR quality = 1),
    eff AS (SELECT image_id, y, x FROM pr ANTI JOIN (FROM hand WHERE state = 2) h USING (image_id, y, x) UNION SELECT image_id, y, x FROM hand WHERE state = 1)"""
       + lab("l", "eff", "true", 8) + """, c AS (SELECT fr.image_id, grp, count(l.y) AS a, count(DISTINCT region_id) AS n FROM fr LEFT JOIN l USING (image_id) GROUP BY 1, 2)
    SELECT grp, count(*) AS n_frames, round(quantile_cont(a / 64, 0.5), 6) AS median_area, round(quantile_cont(n, 0.5), 6) AS median_regions FROM c GROUP BY 1""")
def batch_apply(spark, root):
    """Every frame scored by the stored model, thresholded, pruned, overlaid with hand labels and counted; then group medians."""
    px = T.px8(spark, root)
    mean = px.groupBy("image_id").agg(F.avg("v").alias("m"))
    p = 1 / (1 + F.exp(SCORE_SHIFT - SCORE_SLOPE * (F.col("v") - F.col("m"))))
    return apply_masks(spark, root, px.join(mean, "image_id").filter(p > 0.5).select("image_id", "y", "x"))


def apply_masks(spark, root, found):
    """Group medians of area and regions after the ``found`` pixels of every 8x8 frame are pruned and overlaid with hand labels."""
    labels = T.table(spark, root, "labels")
    size = [F.lit(T.PX_SIDE).alias("fh"), F.lit(T.PX_SIDE).alias("fw")]
    frames = T.table(spark, root, "embeddings").select(F.col("vec_id").alias("image_id"), *size, F.col("label").alias("grp"))
    pruned = R.to_pixels(G.remove_small(R.from_pixels(found.select("image_id", *size, "y", "x")), 2, 4, tile=GRID_TILE)).withColumn("is_pos", F.lit(True))
    state = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    hand = labels.select(F.col("doc_id").alias("image_id"), (F.expr("doc_id div 8") % 8).cast("int").alias("y"), (F.col("doc_id") % 8).cast("int").alias("x"), state.alias("state"))
    hand = hand.filter("state is not null").join(frames.select("image_id"), "image_id", "left_semi")
    mask = R.from_pixels(overlay(pruned, hand).filter("is_pos").select("image_id", *size, "y", "x"))
    per = materialize(frame_counts(mask, frames, tile=GRID_TILE).withColumn("a", F.col("positive_px") / 64), "counts")
    med = per.groupBy("grp").agg(F.count(F.lit(1)).alias("n_frames"), F.percentile("a", 0.5).alias("median_area"), F.percentile("n_regions", 0.5).alias("median_regions"))
    return med.withColumns({"median_area": S.r6("median_area"), "median_regions": S.r6("median_regions")})


def deploy_checks(candidate, production, truth, labels, frames, bands, iou_tol=0.03, ratio_max=2.0, density_min=0.03, new_max=0.02, area_min=0.005,
                  area_max=0.80, **opts):
    """The five deployment checks as rows (check, passed, flagged, detail)."""
    px = lambda runs: R.to_pixels(runs).select("image_id", "y", "x")

    def mean_iou(mask):
        j = px(mask).withColumn("_m", F.lit(1)).join(truth.select("image_id", "y", "x").withColumn("_t", F.lit(1)), ["image_id", "y", "x"], "full")
        per = j.groupBy("image_id").agg((F.sum(F.when(F.col("_m").isNotNull() & F.col("_t").isNotNull(), 1).otherwise(0)) / F.count(F.lit(1))).alias("iou"))
        return per.agg(F.avg("iou").alias("v"))

    c, p = mean_iou(candidate).scalar(), mean_iou(production).scalar()
    one = frames.limit(1)
    accuracy = one.select(F.lit("accuracy").alias("check"), (c >= p - iou_tol).alias("passed"), F.lit(0).cast("long").alias("flagged"), (c - p).alias("detail"))
    size = frames.select("image_id", F.col("fh").alias("height"), F.col("fw").alias("width"))
    ring = A.ring_density(px(candidate), size, bands).withColumnRenamed("density", "a").join(
        A.ring_density(px(production), size, bands).withColumnRenamed("density", "b"), ["image_id", "band"])
    hot = (F.col("a") >= density_min) & (F.col("a") > F.col("b") * ratio_max)
    border = ring.agg(F.count_if(hot).alias("flagged"), F.max("a").alias("detail"))
    new = G.spontaneous(candidate, production, frames, new_max).agg(F.count_if("flagged").alias("flagged"), F.max("fraction").alias("detail"))
    cnt = frame_counts(candidate, frames, **opts)
    frac = F.col("positive_px") / (F.col("fh") * F.col("fw"))
    bad = (F.col("n_regions") == 0) | (frac > area_max) | (frac < area_min)
    degenerate = cnt.agg(F.count_if(bad).alias("flagged"), F.max(frac).alias("detail"))
    j = labels.join(px(candidate).withColumn("_c", F.lit(True)), ["image_id", "y", "x"], "left").join(
        px(production).withColumn("_p", F.lit(True)), ["image_id", "y", "x"], "left")
    moved = F.coalesce("_c", F.lit(False)) != F.coalesce("_p", F.lit(False))
    changed = j.agg(F.count_if(moved).alias("flagged"), F.avg(moved.cast("int")).alias("detail"))
    row = lambda name, df, always=False: df.select(
        F.lit(name).alias("check"), (F.lit(True) if always else F.col("flagged") == 0).alias("passed"), "flagged", "detail")
    return accuracy.union(row("border", border)).union(row("spontaneous", new)).union(row("degenerate", degenerate)).union(row("changed", changed, True))


GATE = FRAMES + f""", c AS (SELECT image_id, y, x FROM grid WHERE p > 0.5), pd AS (SELECT image_id, y, x FROM grid WHERE n > 1), tr AS (SELECT image_id, y, x FROM grid WHERE p > 0.45),
    st AS ({STATES}), ia AS (SELECT avg(i) AS v FROM (SELECT image_id, count(*) FILTER (c.y IS NOT NULL AND tr.y IS NOT NULL) / count(*) AS i FROM c FULL JOIN tr USING (image_id, y, x) GROUP BY 1)),
    ip AS (SELECT avg(i) AS v FROM (SELECT image_id, count(*) FILTER (pd.y IS NOT NULL AND tr.y IS NOT NULL) / count(*) AS i FROM pd FULL JOIN tr USING (image_id, y, x) GROUP BY 1)),
    bands AS (SELECT * FROM (VALUES (0, 5), (5, 10)) t(lo, hi)), cells AS (SELECT image_id, lo, hi, unnest(range(fh)) AS y, fw, fh FROM frames, bands),
    ring AS (SELECT * FROM (SELECT *, unnest(range(fw)) AS x FROM cells) WHERE (y >= lo AND y < hi) OR (y >= fh - hi AND y < fh - lo) OR (x >= lo AND x < hi) OR (x >= fw - hi AND x < fw - lo)),
    dens AS (SELECT r.image_id, lo, avg((c.y IS NOT NULL)::INT) AS a, avg((pd.y IS NOT NULL)::INT) AS b FROM ring r LEFT JOIN c ON c.image_id = r.image_id AND c.y = r.y AND c.x = r.x
    LEFT JOIN pd ON pd.image_id = r.image_id AND pd.y = r.y AND pd.x = r.x GROUP BY 1, 2)""" + lab("l", "grid", "p > 0.5", 8) + """,
    hit AS (SELECT l.image_id, l.region_id, count(*) AS area, bool_or(g.n > 1) AS hit FROM l JOIN grid g USING (image_id, y, x) GROUP BY 1, 2),
    nw AS (SELECT f.image_id, coalesce(sum(area) FILTER (NOT hit), 0) / any_value(fh * fw) AS fr FROM frames f LEFT JOIN hit USING (image_id) GROUP BY 1),
    dg AS (SELECT f.image_id, count(l.y) / any_value(fh * fw) AS fr, count(DISTINCT region_id) AS n FROM frames f LEFT JOIN l USING (image_id) GROUP BY 1),
    ch AS (SELECT (c.y IS NOT NULL) <> (pd.y IS NOT NULL) AS moved FROM st LEFT JOIN c USING (image_id, y, x) LEFT JOIN pd USING (image_id, y, x)),
    checks AS (SELECT 'accuracy' AS "check", ia.v >= ip.v - 0.03 AS passed, 0::BIGINT AS flagged, ia.v - ip.v AS detail FROM ia, ip
    UNION ALL SELECT 'border', count(*) FILTER (a >= 0.03 AND a > b * 2) = 0, count(*) FILTER (a >= 0.03 AND a > b * 2), max(a) FROM dens
    UNION ALL SELECT 'spontaneous', count(*) FILTER (fr > 0.02) = 0, count(*) FILTER (fr > 0.02), max(fr) FROM nw
    UNION ALL SELECT 'degenerate', count(*) FILTER (n = 0 OR fr > 0.8 OR fr < 0.005) = 0, count(*) FILTER (n = 0 OR fr > 0.8 OR fr < 0.005), max(fr) FROM dg
    UNION ALL SELECT 'changed', true, count(*) FILTER (moved), avg(moved::INT) FROM ch)"""


def grid_deploy_checks(spark, root):
    g = T.grid(spark, root)
    return deploy_checks(grid_runs(spark, root, "p > 0.5"), grid_runs(spark, root, "n > 1"), g.filter("p > 0.45"), grid_labels(spark, root),
                         grid_frame_table(spark, root), [(0, 5), (5, 10)], tile=GRID_TILE)


@query("q03_deploy_checks", "grid", GATE + ' SELECT "check", passed, flagged, round(detail, 6) + 0.0 AS detail FROM checks')
def deploy_checks_query(spark, root):
    return grid_deploy_checks(spark, root).withColumn("detail", S.r6("detail"))


@query("r11_candidate_report", "grid", GATE + """ SELECT bool_and(passed) AS would_deploy, count(*) FILTER (NOT passed) AS n_failed,
    string_agg("check", ',' ORDER BY "check") FILTER (NOT passed) AS failed FROM checks""")
def candidate_report(spark, root):
    c = grid_deploy_checks(spark, root)
    failed = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("check")))), ",")
    return c.agg(F.bool_and("passed").alias("would_deploy"), F.count_if(~F.col("passed")).alias("n_failed"), failed.alias("failed")).withColumn(
        "failed", F.when(F.col("n_failed") > 0, F.col("failed")))
