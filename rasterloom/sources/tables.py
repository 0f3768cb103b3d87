"""Explicit schemas of the given tables and the raster views derived from them.

Every view is a lazy projection or aggregate of a given table, so its size
follows the table's.  ``SQL_VIEWS`` states the same views for the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

PX_SIDE = 8          # embeddings are read as 8x8 frames
DOC_WIDTH = 64       # documents of one source are laid out 64 to a row
GRID_WIDTH = 30      # event grids have one column per day
PACK = 1 << 31       # row-major packing of (y, x) into one BIGINT; an INT column cannot reach it


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}.parquet")


class Streamed:
    """Stands in for the session so that a view reads its table as a stream.

    The path is a pattern, since a file stream takes a folder or a pattern but no single file.
    """

    def __init__(self, spark: SparkSession):
        self._reader = spark.readStream
        self.read = self

    def schema(self, ddl: str) -> "Streamed":
        self._reader = self._reader.schema(ddl)
        return self

    def parquet(self, path: str) -> DataFrame:
        return self._reader.option("maxFilesPerTrigger", 8).parquet(f"{path[:-1]}[{path[-1]}]")


def unit_hash(seed: str, *cols) -> F.Column:
    """Deterministic fraction in [0, 1) from a seeded md5, equal in every SQL engine."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def px8(spark: SparkSession, root: str) -> DataFrame:
    """Pixels of the 8x8 frames held in ``embeddings``."""
    e = table(spark, root, "embeddings")
    return e.select(
        F.col("vec_id").alias("image_id"), F.col("label").alias("grp"), F.posexplode("embedding").alias("p", "e")
    ).select(
        "image_id", "grp",
        F.floor(F.col("p") / PX_SIDE).cast("int").alias("y"),
        (F.col("p") % PX_SIDE).cast("int").alias("x"),
        F.col("e").cast("double").alias("v"),
    )


def px8_tiles(spark: SparkSession, root: str) -> DataFrame:
    """The same frames in dense tile form, one tile per frame."""
    e = table(spark, root, "embeddings")
    zero, side = F.lit(0), F.lit(PX_SIDE)
    return e.select(
        F.col("vec_id").cast("string").alias("image_id"), zero.alias("ty"), zero.alias("tx"), zero.alias("y0"),
        zero.alias("x0"), side.alias("h"), side.alias("w"), side.alias("fh"), side.alias("fw"),
        F.col("embedding").cast("array<double>").alias("data"),
    )


def grid(spark: SparkSession, root: str) -> DataFrame:
    """Occupied cells: frame = event type, row = user, column = day."""
    e = table(spark, root, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return (
        e.groupBy(F.col("event_type").alias("image_id"), F.col("user_id").cast("int").alias("y"), day.alias("x"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("s"))
        .withColumn("p", F.col("s") / (F.col("s") + 60.0))
    )


def judged(spark: SparkSession, root: str) -> DataFrame:
    """Sparse ternary labels: 1 positive, 2 negative, absent = no opinion."""
    lab, doc = table(spark, root, "labels"), table(spark, root, "documents").select("doc_id", "source")
    state = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return (
        lab.select("doc_id", state.alias("state")).filter("state IS NOT NULL").join(doc, "doc_id")
        .select(F.col("source").alias("image_id"), *doc_pixel(), "state")
    )


def live_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels of four-pixel frames (four consecutive documents), as loaded now."""
    state = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return table(spark, root, "labels").select(
        F.floor(F.col("doc_id") / 4).cast("long").alias("image_id"), F.lit(0).alias("y"),
        (F.col("doc_id") % 4).cast("int").alias("x"), state.alias("state")).filter("state IS NOT NULL")


def archived_labels(spark: SparkSession, root: str) -> DataFrame:
    """An earlier snapshot of the same frames, from a pass that judged every labelled document by its quality alone."""
    return table(spark, root, "labels").select(
        F.floor(F.col("doc_id") / 4).cast("long").alias("image_id"), F.lit(0).alias("y"),
        (F.col("doc_id") % 4).cast("int").alias("x"), F.when(F.col("quality") == 1, 2).otherwise(1).alias("state"))


def loaded_frames(spark: SparkSession, root: str) -> DataFrame:
    """Frames present in the application: blocks with at least one English document."""
    d = table(spark, root, "documents").select("doc_id", "lang", "source")
    return (d.groupBy(F.floor(F.col("doc_id") / 4).cast("long").alias("image_id"))
            .agg(F.count_if(F.col("lang") == "en").alias("_en"), F.min("source").alias("grp"))
            .filter("_en > 0").select("image_id", "grp", F.lit(1).alias("height"), F.lit(4).alias("width")))


def doc_pixel() -> list:
    return [
        F.floor(F.col("doc_id") / DOC_WIDTH).cast("int").alias("y"),
        (F.col("doc_id") % DOC_WIDTH).cast("int").alias("x"),
    ]


def scores(spark: SparkSession, root: str) -> DataFrame:
    """Per-pixel truth and the probabilities of two models, one pixel per document."""
    d = table(spark, root, "documents").select("doc_id", "lang", "source", "n_chars")
    d = d.withColumn("is_pos", unit_hash("truth", "doc_id") < 0.35)
    gain = F.when(F.col("is_pos"), 1.0).otherwise(0.0)
    return d.select(
        F.col("source").alias("image_id"), "lang", "doc_id", *doc_pixel(), "n_chars", "is_pos",
        (unit_hash("a", "doc_id") * 0.7 + gain * 0.3).alias("pa"),
        (unit_hash("b", "doc_id") * 0.8 + gain * 0.2).alias("pb"),
    )


def rows(spark: SparkSession, root: str) -> DataFrame:
    """Training rows: four numeric features, binary label, image = supplier."""
    li = table(spark, root, "lineitem")
    return li.select(
        F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_key"),
        F.col("l_suppkey").alias("image_id"),
        F.col("l_quantity").alias("f1"), F.col("l_extendedprice").alias("f2"),
        F.col("l_discount").alias("f3"), F.col("l_tax").alias("f4"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def strokes(spark: SparkSession, root: str) -> DataFrame:
    """Brush strokes in event order: image = user, position and radius from the payload."""
    e = table(spark, root, "events")
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int")
    mode = (F.when(F.col("event_type").isin("purchase", "view"), "crack")
            .when(F.col("event_type") == "error", "clear").otherwise("erase"))
    return e.select(
        F.col("event_id").alias("stroke_id"), F.col("user_id").alias("image_id"), "ts", mode.alias("mode"),
        F.floor(k / 10).cast("int").alias("y"), (k % 10).cast("int").alias("x"),
        (1 + F.floor("value").cast("int") % 3).alias("radius"),
    )


def history(spark: SparkSession, root: str) -> DataFrame:
    """Model history: one scored retrain per order."""
    o = table(spark, root, "orders")
    return o.select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("model"), F.col("o_orderdate").alias("created"),
        F.col("o_orderpriority").alias("recipe"), F.col("o_orderstatus").alias("status"),
        (F.col("o_totalprice") / 612345.678).alias("iou"),
        (unit_hash("fp", "o_orderkey") * 0.05).alias("clean_fp"),
    )


def _sql_hash(seed: str, col: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || CAST({col} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0)"


SQL_VIEWS = {
    "px8": """px8 AS (SELECT vec_id AS image_id, label AS grp, CAST(p // 8 AS INT) AS y, CAST(p % 8 AS INT) AS x,
        CAST(embedding[p + 1] AS DOUBLE) AS v
        FROM (SELECT vec_id, label, embedding, unnest(range(len(embedding))) AS p FROM embeddings))""",
    "grid": """grid AS (SELECT *, s / (s + 60.0) AS p FROM (
        SELECT event_type AS image_id, CAST(user_id AS INT) AS y,
        CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS x, count(*) AS n,
        round(sum(value), 4) AS s FROM events GROUP BY ALL))""",
    "judged": """judged AS (SELECT * FROM (SELECT d.source AS image_id, CAST(l.doc_id // 64 AS INT) AS y,
        CAST(l.doc_id % 64 AS INT) AS x, CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 2 END AS state
        FROM labels l JOIN documents d USING (doc_id)) WHERE state IS NOT NULL)""",
    "live": """live AS (SELECT * FROM (SELECT doc_id // 4 AS image_id, 0 AS y, CAST(doc_id % 4 AS INT) AS x,
        CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 2 END AS state FROM labels) WHERE state IS NOT NULL)""",
    "archive": """archive AS (SELECT doc_id // 4 AS image_id, 0 AS y, CAST(doc_id % 4 AS INT) AS x,
        CASE WHEN quality = 1 THEN 2 ELSE 1 END AS state FROM labels)""",
    "loaded": """loaded AS (SELECT doc_id // 4 AS image_id, min(source) AS grp, 1 AS height, 4 AS width FROM documents
        GROUP BY 1 HAVING count(*) FILTER (lang = 'en') > 0)""",
    "scores": f"""scores AS (SELECT image_id, lang, doc_id, y, x, n_chars, is_pos,
        ua * 0.7 + (CASE WHEN is_pos THEN 1.0 ELSE 0.0 END)::DOUBLE * 0.3 AS pa,
        ub * 0.8 + (CASE WHEN is_pos THEN 1.0 ELSE 0.0 END)::DOUBLE * 0.2 AS pb FROM (
        SELECT source AS image_id, lang, doc_id, CAST(doc_id // 64 AS INT) AS y, CAST(doc_id % 64 AS INT) AS x,
        n_chars, CAST({_sql_hash('truth', 'doc_id')} AS DOUBLE) < 0.35 AS is_pos,
        CAST({_sql_hash('a', 'doc_id')} AS DOUBLE) AS ua, CAST({_sql_hash('b', 'doc_id')} AS DOUBLE) AS ub
        FROM documents))""",
    "rows": """rows_ AS (SELECT concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_key,
        l_suppkey AS image_id, l_quantity AS f1, l_extendedprice AS f2, l_discount AS f3, l_tax AS f4,
        CAST(l_returnflag = 'R' AS INT) AS label FROM lineitem)""",
    "strokes": """strokes AS (SELECT stroke_id, image_id, ts, mode, CAST(k // 10 AS INT) AS y, CAST(k % 10 AS INT) AS x,
        radius FROM (SELECT event_id AS stroke_id, user_id AS image_id, ts,
        CASE WHEN event_type IN ('purchase', 'view') THEN 'crack' WHEN event_type = 'error' THEN 'clear'
        ELSE 'erase' END AS mode, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
        1 + CAST(floor(value) AS INT) % 3 AS radius FROM events))""",
    "history": f"""history AS (SELECT o_orderkey AS seq, o_custkey AS model, o_orderdate AS created,
        o_orderpriority AS recipe, o_orderstatus AS status, o_totalprice / 612345.678 AS iou,
        CAST({_sql_hash('fp', 'o_orderkey')} AS DOUBLE) * 0.05 AS clean_fp FROM orders)""",
}


def with_views(names: str, body: str) -> str:
    """Oracle text: the named views as CTEs, then ``body`` (more CTEs start with a comma)."""
    ctes = ",\n".join(SQL_VIEWS[n] for n in names.split())
    return f"WITH RECURSIVE {ctes}\n{body}"
