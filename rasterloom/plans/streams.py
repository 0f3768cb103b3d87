"""Stroke, file-drop and counter queries, in batch form and as drained streams."""

from pyspark.sql import functions as F

from rasterloom.plans.registry import query
from rasterloom.sources import tables as T
from rasterloom.streaming import strokes as W

LABELS = """, c AS (SELECT image_id, max((ts, stroke_id)) AS c FROM strokes WHERE mode = 'clear' GROUP BY 1),
    l AS (SELECT s.* FROM strokes s LEFT JOIN c USING (image_id) WHERE mode <> 'clear' AND (c IS NULL OR (ts, stroke_id) > c)),
    px AS (SELECT l.*, y + dy AS py, x + dx AS px FROM l, range(-3, 4) a(dy), range(-3, 4) b(dx) WHERE dy * dy + dx * dx <= radius * radius
    AND y + dy BETWEEN 0 AND 9 AND x + dx BETWEEN 0 AND 9)
    SELECT image_id, py::INT AS y, px::INT AS x, arg_max(CASE WHEN mode = 'crack' THEN 1 ELSE 2 END, (ts, stroke_id)) AS state FROM px GROUP BY ALL"""


@query("s01_stroke_labels", "strokes", LABELS)
def stroke_labels(spark, root):
    return W.stroke_labels(T.strokes(spark, root), 10, 10)


BATCHES = 4


def drained(spark, root, label, drain):
    """Strokes that arrive in four micro-batches by stroke number, so that many come late."""
    return W.in_turn(T.strokes(spark, root), F.pmod("stroke_id", F.lit(BATCHES)), label, drain)


@query("s01_stroke_stream", "strokes", LABELS)
def stroke_stream(spark, root):
    changes = drained(spark, root, "strokes", lambda stream, base: W.run_to_table(W.stroke_stream(stream, 10, 10, tile=8), W.CHANGES, "update", base))
    return W.latest_labels(changes)


@query("s02_file_drop_stream", None, """WITH i AS (SELECT concat('drop__', substr(sha1(text), 1, 8)) AS ident FROM documents) SELECT DISTINCT ident FROM i""")
def file_drop_stream(spark, root):
    d = T.table(spark, root, "documents").select("doc_id", F.lit("drop.png").alias("name"), F.col("text").alias("content"))
    return W.in_turn(d, F.pmod("doc_id", F.lit(BATCHES)), "drops", W.ingest_drops).select("ident")


@query("s03_live_counters", "strokes", """SELECT image_id, count(*) FILTER (mode = 'crack') AS n_pos, count(*) FILTER (mode = 'erase') AS n_neg FROM strokes GROUP BY 1""")
def live_counters(spark, root):
    schema = "image_id bigint, n_pos bigint, n_neg bigint"
    rows = drained(spark, root, "counters", lambda stream, base: W.run_to_table(W.live_counters(stream), schema, "update", base))
    return rows.groupBy("image_id").agg(F.max_by("n_pos", "epoch").alias("n_pos"), F.max_by("n_neg", "epoch").alias("n_neg"))
