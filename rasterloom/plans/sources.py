"""Source and sink queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.operators import pixels as P
from rasterloom.plans.gates import FRAMES_SQL, frames, predictions
from rasterloom.plans.registry import query
from rasterloom.sources import frames as R
from rasterloom.sources import sinks, tiff
from rasterloom.sources import tables as T


@query("a01_scan_folder")
def scan_folder(spark, root):
    """The data folder itself, scanned for its files."""
    return R.scan_frames(spark, root, extensions=("parquet",), exclude=("region",)).select("name", "grp", "length")


@query("a01_select_frames", None, r"""WITH l AS (SELECT concat('scan', regexp_replace(url, '[?#].*$', ''), CASE page_id % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '.PNG'
    WHEN 2 THEN '.txt' ELSE '_mask.tif' END) AS path FROM pages),
    k AS (SELECT path, regexp_replace(regexp_replace(path, '^.*/', ''), '(.)\.[^.]*$', '\1') AS name FROM l
    WHERE lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) IN ('tif', 'png') AND NOT contains(regexp_replace(path, '^.*/', ''), '_mask'))
    SELECT name, min(path) AS path, regexp_extract(min(path), '([^/]*)/[^/]*$', 1) AS grp FROM k GROUP BY 1""")
def select_frames(spark, root):
    kind = F.element_at(F.array(F.lit(".tif"), F.lit(".PNG"), F.lit(".txt"), F.lit("_mask.tif")), (F.col("page_id") % 4 + 1).cast("int"))
    listing = T.table(spark, root, "pages").select(F.concat(F.lit("scan"), F.regexp_replace("url", r"[?#].*$", ""), kind).alias("path"))
    return R.select_frames(listing, ("tif", "png"), ("_mask",))


DAMAGED = T._sql_hash("bad", "vec_id")


def encoded_frames(spark, root):
    """Every vector as a stored array file; about a tenth arrive truncated."""
    files = R.encode_arrays(T.px8_tiles(spark, root).withColumn("image_id", F.col("image_id").cast("long")))
    bad = T.unit_hash("bad", "image_id") < 0.1
    return files.withColumn("content", F.when(bad, F.expr("substring(content, 1, 100)")).otherwise(F.col("content")))


@query("a02_decode_frames", "px8", f"""SELECT image_id, y, x, round(v, 6) AS v FROM px8 WHERE {DAMAGED.replace('vec_id', 'image_id')} >= 0.1""")
def decode_frames(spark, root):
    good = R.decode_arrays(encoded_frames(spark, root)).filter("error IS NULL")
    return P.tile_pixels(good).select("image_id", "y", "x", S.r6("v").alias("v"))


def encoded_tiffs(spark, root):
    """Every vector as a TIFF file in strips of three rows; about a tenth arrive truncated."""
    files = tiff.encode(T.px8_tiles(spark, root).withColumn("image_id", F.col("image_id").cast("long")), 3)
    bad = T.unit_hash("bad", "image_id") < 0.1
    return files.withColumn("content", F.when(bad, F.expr("substring(content, 1, 100)")).otherwise(F.col("content")))


@query("a02_decode_tiff", "px8", f"""SELECT image_id, y // 3 AS no, y, x, round(v, 6) AS v FROM px8 WHERE {DAMAGED.replace('vec_id', 'image_id')} >= 0.1""")
def decode_tiff(spark, root):
    good = tiff.decode(encoded_tiffs(spark, root)).filter("error IS NULL")
    at = F.col("i")
    return good.select("image_id", "no", "y0", "x0", "w", F.posexplode("data").alias("i", "v")).select(
        "image_id", "no", (F.col("y0") + F.floor(at / F.col("w"))).cast("int").alias("y"), (F.col("x0") + at % F.col("w")).cast("int").alias("x"), S.r6("v").alias("v"))


@query("a02_tiff_quarantine", None, f"SELECT vec_id AS image_id FROM embeddings WHERE {DAMAGED} < 0.1")
def tiff_quarantine(spark, root):
    return tiff.decode(encoded_tiffs(spark, root)).filter("error IS NOT NULL").select("image_id")


@query("a02_quarantine", None, f"SELECT vec_id AS image_id FROM embeddings WHERE {DAMAGED} < 0.1")
def quarantine(spark, root):
    return R.decode_arrays(encoded_frames(spark, root)).filter("error IS NOT NULL").select("image_id")


@query("a03_collapse_planes", None, """WITH g AS (SELECT concat(label, '/', vec_id // 30) AS image_id, vec_id, embedding FROM embeddings),
    n AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS nchan, row_number() OVER (PARTITION BY image_id ORDER BY vec_id) AS c FROM g),
    p AS (SELECT image_id, nchan, c, pos // 8 AS y, pos % 8 AS x, embedding[pos + 1]::DOUBLE AS v FROM (SELECT *, unnest(range(len(embedding))) AS pos FROM n))
    SELECT image_id, y::INT AS y, x::INT AS x, round(CASE WHEN any_value(nchan) IN (3, 4) THEN avg(v) ELSE arg_min(v, c) END, 6) AS v FROM p GROUP BY ALL""")
def collapse_planes(spark, root):
    e = T.table(spark, root, "embeddings").withColumn("image_id", F.concat_ws("/", "label", F.floor(F.col("vec_id") / 30)))
    w = Window.partitionBy("image_id")
    e = e.withColumn("nchan", F.count(F.lit(1)).over(w)).withColumn("c", F.row_number().over(w.orderBy("vec_id")))
    px = e.select("image_id", "nchan", "c", F.posexplode("embedding").alias("p", "v")).select(
        "image_id", "nchan", "c", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    return R.collapse_planes(px).withColumn("v", S.r6("v"))


@query("a04_discover_truth", None, """WITH i AS (SELECT concat('doc', doc_id) AS stem FROM documents SEMI JOIN labels USING (doc_id)) SELECT stem, false AS shipped FROM i WHERE stem NOT IN ('doc1', 'doc3') UNION ALL SELECT 'doc1', true UNION ALL SELECT 'doc3', true""")
def discover_truth(spark, root):
    """Documents stand for frames, and those with a row in ``labels`` have a truth file."""
    stem = F.concat(F.lit("doc"), "doc_id").alias("stem")
    frames, files = (T.table(spark, root, t).select("doc_id", stem) for t in ("documents", "labels"))
    return R.discover_truth(frames, files, ("doc1", "doc3"))


@query("a05_truth_from_probability", "scores", f""", s AS (SELECT image_id, y, x, pa * CASE WHEN {T._sql_hash('scale', 'image_id')} < 0.5 THEN 255.0 ELSE 1.0 END AS p
    FROM scores WHERE {T._sql_hash('shape', 'image_id')} < 0.8), m AS (SELECT image_id, max(p) AS mx FROM s GROUP BY 1)
    SELECT image_id, count(*) AS n, round(avg(CAST(p / CASE WHEN mx > 1.5 THEN 255.0 ELSE 1.0 END >= 0.5 AS INT)), 6) AS coverage FROM s JOIN m USING (image_id) GROUP BY 1""")
def truth_from_probability(spark, root):
    s = T.scores(spark, root)
    prob = s.select("image_id", "y", "x", (F.col("pa") * F.when(T.unit_hash("scale", "image_id") < 0.5, 255.0).otherwise(1.0)).alias("p"))
    size = s.select("image_id").distinct().select(
        "image_id", F.lit(64).alias("height"), F.lit(64).alias("width"), F.lit(64).alias("p_height"),
        F.when(T.unit_hash("shape", "image_id") < 0.8, 64).otherwise(63).alias("p_width"))
    t = R.truth_from_probability(prob, size)
    return t.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), S.r6(F.avg(F.col("is_pos").cast("int"))).alias("coverage"))


@query("a06_expand_packed", "px8", """SELECT image_id, y, x, round(floor((v + 1) * 32767) / 65535.0, 6) AS v FROM px8 WHERE grp <> 0""")
def expand_packed(spark, root):
    e = T.table(spark, root, "embeddings")
    packed = e.select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 32767).cast("int")).alias("u16"))
    existing = e.filter("label = 0").select(F.col("vec_id").alias("image_id"))
    return R.expand_packed(packed, existing, T.PX_SIDE).withColumn("v", S.r6("v"))


@query("a07_ingest_upsert", None, """WITH f AS (SELECT doc_id, lang, concat('up/Frame ', doc_id % 7, '.tif') AS name, text FROM documents),
    i AS (SELECT *, concat(regexp_replace(concat('Frame ', doc_id % 7), '[^A-Za-z0-9_-]', '_', 'g'), '__', substr(sha1(text), 1, 8)) AS ident FROM f)
    SELECT ident, min(name) AS name, min(doc_id) AS file_id FROM i WHERE lang <> 'fr' AND ident NOT IN (SELECT ident FROM i WHERE lang = 'fr') GROUP BY 1""")
def ingest_upsert(spark, root):
    d = T.table(spark, root, "documents")
    f = d.select(F.col("doc_id").alias("file_id"), "lang", F.concat(F.lit("up/Frame "), (F.col("doc_id") % 7), F.lit(".tif")).alias("name"), F.col("text").alias("content"))
    existing = f.filter("lang = 'fr'").select(S.content_id(F.col("name"), F.col("content")).alias("ident")).distinct()
    return R.ingest_upsert(f.filter("lang <> 'fr'"), existing)


@query("a08_incremental_load_plan", None, f"""WITH {FRAMES_SQL}, files AS (SELECT DISTINCT concat('Customer#', lpad(CAST(o_custkey + 100 AS VARCHAR), 9, '0')) AS filename FROM orders)
    SELECT filename, CASE WHEN status = 'ready' THEN 'skip: ready' WHEN EXISTS (SELECT 1 FROM preds p WHERE p.image_id = f.image_id AND p.model_key = '2-HIGH')
    THEN 'skip: predicted' ELSE 'load' END AS action FROM files LEFT JOIN frames f USING (filename)""")
def incremental_load_plan(spark, root):
    key = F.lpad((F.col("o_custkey") + 100).cast("string"), 9, "0")
    files = T.table(spark, root, "orders").select(F.concat(F.lit("Customer#"), key).alias("filename")).distinct()
    return R.load_plan(files, frames(spark, root), predictions(spark, root), "2-HIGH")


@query("a12_mask_polarity", "px8", """, w AS (SELECT image_id, y, x, CASE WHEN v > 0.02 THEN 0 ELSE 255 END AS v FROM px8),
    s AS (SELECT image_id, avg(CAST(v < 128 AS INT)) AS share FROM w GROUP BY 1)
    SELECT image_id, y, x, v, CASE WHEN share <= 0.5 THEN v < 128 ELSE v >= 128 END AS is_pos FROM w JOIN s USING (image_id)""")
def mask_polarity(spark, root):
    written = sinks.mask_bytes(T.px8(spark, root).withColumn("is_pos", F.col("v") > 0.02))
    return P.inferred_polarity(written)
