"""Neighbourhood queries: filters, features, morphology, lookups and profiles."""

from pyspark.sql import functions as F

from rasterloom.functions import kernels as K
from rasterloom.functions import scalars as S
from rasterloom.operators import composites as C
from rasterloom.operators import halo as H
from rasterloom.operators import lookup as E
from rasterloom.operators import pixels as P
from rasterloom.operators import profiles as L
from rasterloom.operators import regions as G
from rasterloom.operators import runs as R
from rasterloom.operators.quantiles import exact_percentiles
from rasterloom.plans.regions import FRAMES, GRID_TILE, grid_frame_table, grid_runs, lab
from rasterloom.plans.registry import query
from rasterloom.session import materialize
from rasterloom.sources import tables as T


def as_rows(tiles, columns, names, kind="long"):
    px = P.tile_pixels(tiles, columns, names)
    return px.select(F.col("image_id").cast(kind).alias("image_id"), "y", "x", *[F.round(n, 5).alias(n) for n in names])


def taps(sigma, order):
    off, w = K.gaussian_taps(sigma, order)
    return ", ".join(f"({o}, {float(v)!r}::DOUBLE)" for o, v in zip(off.tolist(), w.tolist()))


def reflect8(expr):
    """SQL index of an 8-wide axis under the reflecting border."""
    return f"(CASE WHEN ((({expr}) % 16) + 16) % 16 < 8 THEN ((({expr}) % 16) + 16) % 16 ELSE 15 - ((({expr}) % 16) + 16) % 16 END)"


def sql_filter(name, src, value, sy, oy, sx, ox, border="reflect"):
    """Oracle CTEs of a separable filter over 8x8 frames."""
    idx = reflect8 if border == "reflect" else (lambda e: f"greatest(least({e}, 7), 0)")
    return f""", {name}_y AS (SELECT a.image_id, t.y, a.x, sum(k.w * a.{value}) AS v FROM (SELECT unnest(range(8)) AS y) t,
    (VALUES {taps(sy, oy)}) k(o, w) JOIN {src} a ON a.y = {idx('t.y + k.o')} GROUP BY ALL),
    {name} AS (SELECT a.image_id, a.y, t.x, sum(k.w * a.v) AS v FROM (SELECT unnest(range(8)) AS x) t,
    (VALUES {taps(sx, ox)}) k(o, w) JOIN {name}_y a ON a.x = {idx('t.x + k.o')} GROUP BY ALL)"""


def out_sql(expr, name, joins):
    return f" SELECT a.image_id, CAST(a.y AS INT) AS y, CAST(a.x AS INT) AS x, round({expr}, 5) + 0.0 AS {name} FROM {joins}"


def px8_bands(spark, root, bands, halo=32):
    return H.apply_bands(T.px8_tiles(spark, root), halo, bands, T.PX_SIDE)


@query("c01_gaussian", "px8", sql_filter("g", "px8", "v", 2, 0, 2, 0) + out_sql("a.v", "smooth", "g a"))
def gaussian(spark, root):
    return as_rows(px8_bands(spark, root, {"smooth": lambda w: K.gaussian(w, 2)}), ["smooth"], ["smooth"])


@query("c02_gradient_magnitude", "px8", sql_filter("a_", "px8", "v", 1, 1, 1, 0) + sql_filter("b_", "px8", "v", 1, 0, 1, 1)
       + out_sql("sqrt(a.v * a.v + b.v * b.v)", "grad", "a_ a JOIN b_ b USING (image_id, y, x)"))
def gradient_magnitude(spark, root):
    return as_rows(px8_bands(spark, root, {"grad": lambda w: K.gradient_magnitude(w, 1)}), ["grad"], ["grad"])


@query("c03_laplacian", "px8", sql_filter("a_", "px8", "v", 1, 2, 1, 0) + sql_filter("b_", "px8", "v", 1, 0, 1, 2)
       + out_sql("a.v + b.v", "lap", "a_ a JOIN b_ b USING (image_id, y, x)"))
def laplacian(spark, root):
    return as_rows(px8_bands(spark, root, {"lap": lambda w: K.laplacian(w, 1)}), ["lap"], ["lap"])


@query("c04_local_std", "px8", ", sq AS (SELECT image_id, y, x, v * v AS v FROM px8)" + sql_filter("a_", "px8", "v", 2, 0, 2, 0)
       + sql_filter("b_", "sq", "v", 2, 0, 2, 0) + out_sql("sqrt(greatest(b.v - a.v * a.v, 0))", "texture", "a_ a JOIN b_ b USING (image_id, y, x)"))
def local_std(spark, root):
    return as_rows(px8_bands(spark, root, {"texture": lambda w: K.local_std(w, 2)}), ["texture"], ["texture"])


def sql_grid_filter(name, src, sy, oy, sx, ox):
    """Oracle CTEs of a separable filter over dense grid frames of any height, reflected at their borders."""
    idx = lambda e, n: f"(CASE WHEN ((({e}) % (2 * {n})) + 2 * {n}) % (2 * {n}) < {n} THEN ((({e}) % (2 * {n})) + 2 * {n}) % (2 * {n}) ELSE 2 * {n} - 1 - ((({e}) % (2 * {n})) + 2 * {n}) % (2 * {n}) END)"
    return f""", {name}_y AS (SELECT t.image_id, t.fh, t.y, t.x, sum(k.w * a.v) AS v FROM {src} t, (VALUES {taps(sy, oy)}) k(o, w)
    JOIN {src} a ON a.image_id = t.image_id AND a.x = t.x AND a.y = {idx('t.y + k.o', 't.fh')} GROUP BY ALL),
    {name} AS (SELECT t.image_id, t.y, t.x, sum(k.w * a.v) AS v FROM {name}_y t, (VALUES {taps(sx, ox)}) k(o, w)
    JOIN {name}_y a ON a.image_id = t.image_id AND a.y = t.y AND a.x = {idx('t.x + k.o', 30)} GROUP BY ALL)"""


DENSE = FRAMES + """, cells AS (SELECT image_id, fh, y, unnest(range(30)) AS x FROM (SELECT image_id, fh, unnest(range(fh)) AS y FROM frames)),
    dense AS (SELECT c.image_id, c.fh, c.y, c.x, coalesce(g.p, 0.0) AS v FROM cells c LEFT JOIN grid g USING (image_id, y, x))"""
SEAM_TILE = 32


def grid_bands(spark, root, bands, halo):
    """Bands of the event grid cut into 32-cell tiles, so that every tile takes its halo from its neighbours."""
    tiles = H.tiles_from_pixels(T.grid(spark, root), grid_frame_table(spark, root), SEAM_TILE, "p")
    return H.apply_bands(tiles, halo, bands, SEAM_TILE)


@query("c01_gaussian_tiled", "grid", DENSE + sql_grid_filter("g", "dense", 2, 0, 2, 0) + out_sql("a.v", "smooth", "g a"))
def gaussian_tiled(spark, root):
    return as_rows(grid_bands(spark, root, {"smooth": lambda w: K.gaussian(w, 2)}, 8), ["smooth"], ["smooth"], "string")


@query("c03_laplacian_tiled", "grid", DENSE + sql_grid_filter("a_", "dense", 1, 2, 1, 0) + sql_grid_filter("b_", "dense", 1, 0, 1, 2)
       + out_sql("a.v + b.v", "lap", "a_ a JOIN b_ b USING (image_id, y, x)"))
def laplacian_tiled(spark, root):
    return as_rows(grid_bands(spark, root, {"lap": lambda w: K.laplacian(w, 1)}, 4), ["lap"], ["lap"], "string")


@query("c04_local_std_tiled", "grid", DENSE + ", sq AS (SELECT image_id, fh, y, x, v * v AS v FROM dense)" + sql_grid_filter("a_", "dense", 2, 0, 2, 0)
       + sql_grid_filter("b_", "sq", 2, 0, 2, 0) + out_sql("sqrt(greatest(b.v - a.v * a.v, 0))", "texture", "a_ a JOIN b_ b USING (image_id, y, x)"))
def local_std_tiled(spark, root):
    return as_rows(grid_bands(spark, root, {"texture": lambda w: K.local_std(w, 2)}, 8), ["texture"], ["texture"], "string")


@query("c05_feature_stack")
def feature_stack(spark, root):
    return as_rows(H.feature_stack(T.px8_tiles(spark, root)), list(H.FEATURE_NAMES), list(H.FEATURE_NAMES))


@query("c06_tiled_features")
def tiled_features(spark, root):
    """Feature stack of the event grid, cut into tiles with a full halo around each."""
    g = T.grid(spark, root)
    frames = g.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("fh")).withColumn("fw", F.lit(T.GRID_WIDTH))
    tiles = H.tiles_from_pixels(g, frames, 64, "p")
    return as_rows(H.feature_stack(tiles, 64), list(H.FEATURE_NAMES), list(H.FEATURE_NAMES), "string")


@query("c07_flatfield", "px8", """, u AS (SELECT image_id, y, x, greatest(v + 0.2, 0) AS v FROM px8),
    ref AS (SELECT image_id, quantile_cont(v, 0.5) AS r FROM u WHERE v > 0 GROUP BY 1),
    val AS (SELECT image_id, y, x, u.v, CAST(u.v >= greatest(0.05 * r, 1e-6) AS DOUBLE) AS ok, r FROM u JOIN ref USING (image_id)),
    nn AS (SELECT image_id, y, x, v * ok AS v FROM val), dd AS (SELECT image_id, y, x, ok AS v FROM val)"""
       + sql_filter("num", "nn", "v", 1, 0, 2, 0, "nearest") + sql_filter("den", "dd", "v", 1, 0, 2, 0, "nearest")
       + out_sql("CASE WHEN a.ok = 0 THEN 0 ELSE a.v / greatest(n.v / greatest(d.v, 1e-3), greatest(1e-3 * r, 1e-9)) END", "flat",
                 "val a JOIN num n USING (image_id, y, x) JOIN den d USING (image_id, y, x)"))
def flatfield(spark, root):
    t = T.px8_tiles(spark, root).withColumn("data", F.transform("data", lambda v: F.greatest(v + 0.2, F.lit(0.0))))
    return as_rows(flatfield_tiles(t, 1, 2, T.PX_SIDE), ["flat"], ["flat"])


def flatfield_tiles(tiles, sigma_y, sigma_x, tile):
    """Flat-field of tiled frames; the reference is the median of a frame's positive pixels, 1 if it has none."""
    px = C.pixels(tiles, "data").filter("data > 0").select("image_id", "data")
    ref = exact_percentiles(px, ["image_id"], "data", {"ref": 0.5})
    halo = int(K.TRUNCATE * max(sigma_y, sigma_x) + 0.5)
    return H.apply_bands(tiles.join(ref, "image_id", "left").withColumn("ref", F.coalesce("ref", F.lit(1.0))), halo, {"flat": lambda w, ref: K.flat_field(w, ref, sigma_y, sigma_x)}, tile, ["ref"])


@query("c08_subtract_background")
def subtract_background(spark, root):
    return background_free(T.px8_tiles(spark, root), 40, T.PX_SIDE).select(F.col("image_id").cast("long").alias("image_id"), "y", "x", "v8")


def background_free(tiles, sigma, tile):
    """Pixels less their blurred background, stretched between two percentiles of the whole frame, as 0..255."""
    halo = int(K.TRUNCATE * sigma + 0.5)
    flat = H.apply_bands(tiles, halo, {"flat": lambda w: w.centre() - w.gauss(sigma)}, tile)
    px = materialize(P.tile_pixels(flat, ["flat"], ["v"]), "background")
    return P.normalize_rows(px, plo=0.005, phi=0.995).withColumn("v8", F.floor(F.col("v") * 255).cast("int"))


@query("c09_local_contrast", "px8", """, u AS (SELECT image_id, y, x, v + 0.6 AS v FROM px8),
    o AS (SELECT a.d AS dy, b.d AS dx FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d)),
    n AS (SELECT c.image_id, c.y, c.x, avg(u.v) AS m, avg(u.v * u.v) AS m2 FROM u c, o JOIN u ON u.image_id = c.image_id
    AND u.y = greatest(least(c.y + o.dy, 7), 0) AND u.x = greatest(least(c.x + o.dx, 7), 0) GROUP BY ALL)"""
       + out_sql("sqrt(greatest(m2 - m * m, 0)) / greatest(m, 0.02)", "contrast", "n a"))
def local_contrast(spark, root):
    t = T.px8_tiles(spark, root).withColumn("data", F.transform("data", lambda v: v + 0.6))
    return as_rows(H.apply_bands(t, 2, {"contrast": lambda w: K.local_contrast(w, 3)}, T.PX_SIDE), ["contrast"], ["contrast"])


@query("c28_ridge_response")
def ridge_response(spark, root):
    return as_rows(C.ridge_response(T.px8_tiles(spark, root), T.PX_SIDE), ["ridge"], ["ridge"])


def border_sql(src, line, pos, band, ref):
    return f""", ref_{line} AS (SELECT image_id, {line}, quantile_cont(v, 0.5) AS r FROM {src} WHERE {ref} GROUP BY ALL),
    b_{line} AS (SELECT a.*, r, least(greatest(r / greatest(v, greatest(0.05 * r, 1e-6)), 0.1), 10.0) AS ratio, v >= greatest(0.05 * r, 1e-6) AS live
    FROM {src} a JOIN ref_{line} USING (image_id, {line}) WHERE {band}),
    f_{line} AS (SELECT *, CASE WHEN live THEN least(greatest(exp(w * w * (3 - 2 * w) * ln(ratio)), 0.1), 10.0) ELSE 1.0 END AS f FROM
    (SELECT *, least(greatest((abs(ln(ratio)) - ln(1.1)) / (ln(1.8) - ln(1.1)), 0), 1) AS w FROM b_{line})),
    h_{line} AS (SELECT image_id, count(*) FILTER (abs(f - 1) > 0.02) AS hits FROM f_{line} GROUP BY 1),
    x_{line} AS (SELECT image_id, y, x, CASE WHEN hits >= 9 THEN v * f ELSE v END AS v FROM f_{line} JOIN h_{line} USING (image_id)
    UNION ALL SELECT image_id, y, x, v FROM {src} WHERE NOT ({band}))"""


@query("c10_border_defect_fix", "px8", ", u AS (SELECT image_id, y, x, v + 0.35 AS v FROM px8)"
       + border_sql("u", "y", "x", "x < 2", "x >= 2 AND x < 5") + border_sql("x_y", "x", "y", "y >= 6", "y >= 3 AND y < 6")
       + " SELECT image_id, y, x, round(v, 5) AS v FROM x_x")
def border_defect_fix(spark, root):
    px = T.px8(spark, root).select("image_id", F.lit(8).alias("fh"), F.lit(8).alias("fw"), "y", "x", (F.col("v") + 0.35).alias("v"))
    px = L.border_fix(px, "left", 2, 3, min_hits=9).drop("hits")
    px = L.border_fix(px, "bottom", 2, 3, min_hits=9)
    return px.select("image_id", "y", "x", F.round("v", 5).alias("v"))


@query("c11_line_profiles", "px8", """SELECT image_id, 'row' AS axis, y AS pos, round(quantile_cont(v, 0.5), 6) AS v FROM px8 GROUP BY ALL
    UNION ALL SELECT image_id, 'col', x, round(quantile_cont(v, 0.5), 6) FROM px8 GROUP BY ALL""")
def line_profiles(spark, root):
    return L.line_profiles(T.px8(spark, root)).withColumn("v", S.r6("v"))


MASK = """, m AS (SELECT image_id, y, x FROM grid WHERE p > 0.4)""" + FRAMES
DISK2 = ", ".join(f"({dy},{dx})" for dy, hw in R.disk(2) for dx in range(-hw, hw + 1))
BOX1 = ", ".join(f"({dy},{dx})" for dy, hw in R.box(1) for dx in range(-hw, hw + 1))


def dil(name, src, offs):
    return f""", {name} AS (SELECT DISTINCT image_id, (m.y + dy)::INT AS y, (m.x + dx)::INT AS x FROM {src} m JOIN frames USING (image_id),
    (VALUES {offs}) o(dy, dx) WHERE m.y + dy BETWEEN 0 AND fh - 1 AND m.x + dx BETWEEN 0 AND fw - 1)"""


def ero(name, src, offs):
    n = offs.count("(")
    return f""", {name} AS (SELECT a.image_id, a.y, a.x FROM {src} a, (VALUES {offs}) o(dy, dx) JOIN {src} b ON b.image_id = a.image_id
    AND b.y = a.y + o.dy AND b.x = a.x + o.dx GROUP BY ALL HAVING count(*) = {n})"""


def grid_mask(spark, root):
    return grid_runs(spark, root, "p > 0.4")


@query("c19_dilate_disk", "grid", MASK + dil("d", "m", DISK2) + " SELECT image_id, y, x FROM d")
def dilate_disk(spark, root):
    return R.to_pixels(R.dilate(grid_mask(spark, root), R.disk(2)))


@query("c19_erode_square", "grid", ", m AS (SELECT image_id, y, x FROM grid)" + ero("e", "m", BOX1) + " SELECT image_id, y, x FROM e")
def erode_square(spark, root):
    return R.to_pixels(R.erode(grid_runs(spark, root), R.box(1)))


@query("c19_open_square", "grid", ", m AS (SELECT image_id, y, x FROM grid)" + FRAMES + ero("e", "m", BOX1) + dil("d", "e", BOX1) + " SELECT image_id, y, x FROM d")
def open_square(spark, root):
    return R.to_pixels(R.opening(grid_runs(spark, root), R.box(1)))


@query("c19_close_disk", "grid", MASK + dil("d", "m", DISK2) + ero("e", "d", DISK2) + " SELECT image_id, y, x FROM e")
def close_disk(spark, root):
    return R.to_pixels(R.closing(grid_mask(spark, root), R.disk(2)))


BACK = """, cells AS (SELECT image_id, unnest(range(fh))::INT AS y, fh, fw FROM frames), dense AS (SELECT image_id, y, unnest(range(fw))::INT AS x,
    fh, fw FROM cells), bg AS (SELECT d.* FROM dense d ANTI JOIN m ON m.image_id = d.image_id AND m.y = d.y AND m.x = d.x)"""


@query("c20_fill_holes", "grid", ", m AS (SELECT image_id, y, x FROM grid)" + FRAMES + BACK + lab("l", "bg", "true", 4) + """,
    h AS (SELECT l.image_id, region_id FROM l JOIN frames f USING (image_id) GROUP BY 1, 2
    HAVING NOT bool_or(y = 0 OR x = 0 OR y = fh - 1 OR x = fw - 1))
    SELECT image_id, y, x FROM m UNION ALL SELECT image_id, y, x FROM l SEMI JOIN h USING (image_id, region_id)""")
def fill_holes(spark, root):
    return R.to_pixels(G.fill_holes(grid_runs(spark, root), tile=GRID_TILE))


@query("c20_remove_small_holes", "grid", ", m AS (SELECT image_id, y, x FROM grid)" + FRAMES + BACK + lab("l", "bg", "true", 4) + """,
    h AS (SELECT image_id, region_id FROM l GROUP BY 1, 2 HAVING count(*) <= 3)
    SELECT image_id, y, x FROM m UNION ALL SELECT image_id, y, x FROM l SEMI JOIN h USING (image_id, region_id)""")
def remove_small_holes(spark, root):
    return R.to_pixels(G.fill_holes(grid_runs(spark, root), max_area=3, tile=GRID_TILE))


def downsample(px, step):
    """Every ``step``-th row and column."""
    return px.filter((F.col("y") % step == 0) & (F.col("x") % step == 0)).withColumns(
        {"y": F.floor(F.col("y") / step).cast("int"), "x": F.floor(F.col("x") / step).cast("int")})


def upsample(px, step, fh, fw):
    """Repeat every pixel ``step`` times each way, cropped to the frame."""
    out = px.withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(step - 1)))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(step - 1))))
    out = out.withColumns({"y": F.col("y") * step + F.col("_a"), "x": F.col("x") * step + F.col("_b")}).drop("_a", "_b")
    return out.filter((F.col("y") < fh) & (F.col("x") < fw))


@query("c21_down_and_upsample", "px8", """SELECT a.image_id, a.y, a.x, round(b.v, 6) AS v FROM px8 a JOIN px8 b ON a.image_id = b.image_id
    AND b.y = (a.y // 3) * 3 AND b.x = (a.x // 3) * 3""")
def down_and_upsample(spark, root):
    px = T.px8(spark, root).select("image_id", "y", "x", S.r6("v").alias("v"))
    return upsample(downsample(px, 3), 3, 8, 8)


@query("c23_tile_pitch", "grid", """, p AS (SELECT image_id, y, avg(s) AS m FROM grid GROUP BY 1, 2), c AS (SELECT image_id, y, m - avg(m) OVER
    (PARTITION BY image_id) AS m FROM p), z AS (SELECT image_id, sum(m * m) AS c0 FROM c GROUP BY 1),
    ac AS (SELECT a.image_id, b.y - a.y AS lag, sum(a.m * b.m) AS c FROM c a JOIN c b ON a.image_id = b.image_id AND b.y - a.y BETWEEN 5 AND 39
    GROUP BY 1, 2), r AS (SELECT image_id, lag, round(c / (c0 + 1e-12), 9) AS r FROM ac JOIN z USING (image_id))
    SELECT image_id, CASE WHEN max(r) > 0.05 THEN arg_max(lag, (r, -lag)) END AS pitch, round(max(r), 6) AS r FROM r GROUP BY 1""")
def tile_pitch(spark, root):
    g = T.grid(spark, root).withColumn("v", F.col("s"))
    return L.tile_pitch(g, "y", 5, 40).withColumn("r", S.r6("r"))


@query("c24_crack_contrast", "grid", ", m AS (SELECT image_id, y, x FROM grid WHERE p > 0.7)" + FRAMES + dil("d", "m", ", ".join(
    f"({dy},{dx})" for dy in range(-2, 3) for dx in range(-2, 3) if abs(dy) + abs(dx) <= 2)) + """
    SELECT g.image_id, round(abs(avg(s) FILTER (g.p > 0.7) - avg(s) FILTER (g.p <= 0.7)), 6) AS contrast FROM d JOIN grid g USING (image_id, y, x) GROUP BY 1""")
def crack_contrast_query(spark, root):
    g = T.grid(spark, root).withColumn("v", F.col("s"))
    return crack_contrast(g, grid_runs(spark, root, "p > 0.7"), 2).withColumn("contrast", S.r6("contrast"))


def crack_contrast(px, mask, width=6):
    """Difference of the means inside the mask and in the ring of ``width`` cross-shaped dilations around it."""
    diamond = [(dy, width - abs(dy)) for dy in range(-width, width + 1)]
    inside = R.to_pixels(mask).withColumn("_in", F.lit(True))
    near = R.to_pixels(R.dilate(mask, diamond)).join(inside, ["image_id", "y", "x"], "left")
    j = px.select("image_id", "y", "x", "v").join(near, ["image_id", "y", "x"])
    return j.groupBy("image_id").agg(F.abs(F.avg(F.when(F.col("_in"), F.col("v"))) - F.avg(F.when(F.col("_in").isNull(), F.col("v")))).alias("contrast"))


def embedding_tiles(spark, root):
    """Overlapping tiles: four consecutive vectors of ``embeddings`` cover one frame, each an 8x8 grid at stride 4."""
    k = (F.col("vec_id") % 4).cast("int")
    return T.table(spark, root, "embeddings").select(
        F.floor(F.col("vec_id") / 4).cast("long").alias("image_id"), k.alias("tile_ord"), (F.floor(k / 2) * 16).cast("int").alias("y0"),
        ((k % 2) * 20).cast("int").alias("x0"), F.lit(1).alias("c"), F.lit(8).alias("gy"), F.lit(8).alias("gx"),
        F.col("embedding").cast("array<double>").alias("e"))


def lookup_pixels(spark, root):
    return T.table(spark, root, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "_e")).select(
        F.floor(F.col("vec_id") / 4).cast("long").alias("image_id"), (F.floor(F.col("p") / 8) * 6 + F.col("vec_id") % 4).cast("int").alias("y"),
        ((F.col("p") % 8) * 6).cast("int").alias("x"))


TILES_SQL = """tl AS (SELECT vec_id // 4 AS image_id, (vec_id % 4)::INT AS tile_ord, ((vec_id % 4) // 2 * 16)::INT AS y0, (vec_id % 2 * 20)::INT AS x0, embedding AS e
    FROM embeddings), pxl AS (SELECT vec_id // 4 AS image_id, (p // 8 * 6 + vec_id % 4)::INT AS y, (p % 8 * 6)::INT AS x FROM
    (SELECT vec_id, unnest(range(len(embedding))) AS p FROM embeddings)),
    own AS (SELECT pxl.image_id, y, x, arg_max((tile_ord, y0, x0), tile_ord) AS t FROM pxl JOIN tl ON pxl.image_id = tl.image_id AND y >= y0 AND y < y0 + 32
    AND x >= x0 AND x < x0 + 32 GROUP BY ALL)"""


@query("e04_pixel_by_tile", None, f"""WITH {TILES_SQL} SELECT image_id, y, x, struct_extract_at(t, 1) AS tile_ord FROM own""")
def pixel_by_tile(spark, root):
    return E.owning_tile(lookup_pixels(spark, root), embedding_tiles(spark, root).select("image_id", "tile_ord", "y0", "x0"), 32).select(
        "image_id", "y", "x", "tile_ord")


@query("c25_bilinear_lookup", None, f"""WITH {TILES_SQL}, rc AS (SELECT own.image_id, y, x, e, least(greatest((y - struct_extract_at(t, 2)) / 4.0 - 0.5, 0), 7) AS r,
    least(greatest((x - struct_extract_at(t, 3)) / 4.0 - 0.5, 0), 7) AS c FROM own JOIN tl ON tl.image_id = own.image_id AND tl.tile_ord = struct_extract_at(t, 1)),
    k AS (SELECT *, floor(r)::INT AS r0, floor(c)::INT AS c0, least(floor(r)::INT + 1, 7) AS r1, least(floor(c)::INT + 1, 7) AS c1, r - floor(r) AS dr, c - floor(c) AS dc FROM rc)
    SELECT image_id, y, x, round(e[r0 * 8 + c0 + 1]::DOUBLE * (1 - dr) * (1 - dc) + e[r0 * 8 + c1 + 1]::DOUBLE * (1 - dr) * dc
    + e[r1 * 8 + c0 + 1]::DOUBLE * dr * (1 - dc) + e[r1 * 8 + c1 + 1]::DOUBLE * dr * dc, 5) + 0.0 AS v FROM k""")
def bilinear_lookup(spark, root):
    out = E.bilinear_lookup(lookup_pixels(spark, root), embedding_tiles(spark, root), 32, 4.0)
    return out.select("image_id", "y", "x", F.round(F.get("vec", F.lit(0)), 5).alias("v"))


def sized_frames(spark, root):
    """Frame sizes drawn from the documents: 900 to 6400 pixels a side."""
    return T.table(spark, root, "documents").select(
        F.col("doc_id").alias("image_id"), (900 + F.col("n_chars") * 7 % 3100).cast("int").alias("fh"), (900 + F.col("n_chars") * 13 % 5500).cast("int").alias("fw"))


def starts_sql(dim, size, overlap):
    stop = f"greatest({dim} - {overlap or 1}, 1)"
    return f"unnest(list_distinct(list_transform(range(0, {stop}, {size - overlap}), lambda a: greatest(least(a + {size}, {dim}) - {size}, 0))))"


def grid_sql(size, overlap):
    return f"""WITH f AS (SELECT doc_id AS image_id, 900 + n_chars * 7 % 3100 AS fh, 900 + n_chars * 13 % 5500 AS fw FROM documents),
    a AS (SELECT *, {starts_sql('fh', size, overlap)} AS y0 FROM f), b AS (SELECT *, {starts_sql('fw', size, overlap)} AS x0 FROM a)
    SELECT image_id, y0::INT AS y0, least(y0 + {size}, fh)::INT AS y1, x0::INT AS x0, least(x0 + {size}, fw)::INT AS x1 FROM b"""


@query("c26_tile_grid", None, grid_sql(1024, 0))
def tile_grid(spark, root):
    return E.covering_tiles(sized_frames(spark, root), 1024)


@query("c26_tile_grid_overlap", None, grid_sql(1024, 128))
def tile_grid_overlap(spark, root):
    return E.covering_tiles(sized_frames(spark, root), 1024, 128)


@query("c27_pick_level", None, """WITH l AS (SELECT p_brand AS encoder, p_partkey AS level, 1024 AS tile_px, p_size * 3 - 2 AS cells FROM part)
    SELECT encoder, arg_min(level, (abs(tile_px / cells - 16), level)) AS level, round(arg_min(tile_px / cells, (abs(tile_px / cells - 16), level)), 6) AS stride
    FROM l WHERE cells > 1 GROUP BY 1""")
def pick_level(spark, root):
    lv = T.table(spark, root, "part").select(F.col("p_brand").alias("encoder"), F.col("p_partkey").alias("level"), F.lit(1024).alias("tile_px"),
                                             (F.col("p_size") * 3 - 2).alias("cells"))
    return E.pick_level(lv).withColumn("stride", S.r6("stride"))


GRID_CUT = 64


def grid_tiles(spark, root, value="p"):
    return H.tiles_from_pixels(T.grid(spark, root), grid_frame_table(spark, root), GRID_CUT, value)


def mask_rows(runs):
    return R.to_pixels(runs).select("image_id", "y", "x")


@query("c22_specimen_support")
def specimen_support(spark, root):
    tiles = grid_tiles(spark, root)
    coarse = C.specimen_support(tiles, GRID_CUT, step=2, open_radius=1, close_radius=2)
    return mask_rows(C.refine(coarse, C.frames_of(tiles), 2))


@query("d09_legacy_postprocess")
def legacy_postprocess(spark, root):
    return mask_rows(C.legacy_postprocess(grid_tiles(spark, root), GRID_CUT, sigma=1.0, threshold=0.3, close=1, min_size=6, hole_max=40,
                                          round_max=20, low=0.2, grow=2, fill=5, border=1))


OFF = {"sigma": 2.0, "dark_max": 0.12, "min_fraction": 0.002, "grow": 1}


@query("d20_off_specimen")
def off_specimen(spark, root):
    return mask_rows(C.off_specimen(grid_tiles(spark, root), GRID_CUT, **OFF))


@query("d21_allowed_region")
def allowed_region(spark, root):
    return mask_rows(C.allowed_region(grid_tiles(spark, root), GRID_CUT, sigma=1.5, bright_min=0.15, close=2, inset=1, border=1, wedge_fraction=0.002))


@query("d22_false_positive_zone")
def false_positive_zone(spark, root):
    return mask_rows(C.false_positive_zone(grid_tiles(spark, root), grid_mask(spark, root), GRID_CUT, sigma=1.0, dark_max=0.05, wedge_margin=1,
                                           edge_ring=2, speckle_area=6, off_args=OFF))


@query("d23_crack_cores")
def crack_cores(spark, root):
    return mask_rows(C.crack_cores(grid_tiles(spark, root), GRID_CUT, sigma=3.0, k=0.6, min_area=8, min_ecc=0.6, max_fraction=0.9, off_args=OFF))


@query("d23_thick_cracks")
def thick_cracks(spark, root):
    return mask_rows(C.thick_cracks(grid_tiles(spark, root), GRID_CUT, bright_min=0.1, close=3, min_area=3, min_ecc=0.3, dominance=0.0,
                                    max_fraction=0.9, open_radius=1))
