"""Mixing sources to target weights: hash-random order, range prefix sums, exact cuts.

Every document gets a random key from its id.  Each source is cut into key ranges of about
``RANGE_ROWS`` documents; sizes are summed per range, prefix sums over ranges tell in which range
the source's budget ends, and only that range is sorted.  A third of all rows in one source is
just more ranges.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)  # by place of the source in code-point order, repeating
CAP = 3  # a source gives at most so many times its size
RANGE_ROWS = 1000
KEY_SPAN = float(1 << 48)
RESULTS = ("size", "source_size", "target", "taken")


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _source_key(source: Column) -> Column:
    """Non-null text in the sources' order: code points, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_plan(sized: DataFrame) -> DataFrame:
    """One row per source key: size, documents, target, whole epochs and the rest to take.

    A target is the least of ``CAP`` times the size and weight times a water level; the level is the
    largest of (total - caps before) / (weights from here on) over sources in order of cap per weight,
    which is where repeated resharing of the excess ends.
    """
    per = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(Window.orderBy("_source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * CAP).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "_source")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()).cast("double")
    per = per.withColumn("level", (total - before) / onward)
    per = per.withColumn("target", F.least("cap", F.max("level").over(Window.partitionBy()) * F.col("weight")))
    budget = F.least(F.floor(F.col("target") + 0.5).cast("bigint"), F.col("source_size") * CAP)
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("bigint")
    per = per.withColumn("budget", budget).withColumn("epochs", epochs)
    return per.select("_source", "source_size", "target", "epochs", (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("rest"),
                      F.ceil(F.col("rows") / RANGE_ROWS).cast("bigint").alias("ranges"))


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with columns size, source_size, target and taken.

    ``taken`` is the number of the document's words that the mix takes: its size once per whole
    epoch of its source, plus what the cut leaves of it in the last, partial epoch, so that a source's
    taken words are exactly its rounded target.  Null texts and texts of blanks have size 0 and
    give 0.  A null source is a source of its own, last in order.  Rows alike in all but other columns
    are each a document; equal keys are ordered by id, size and a hash of the text.  A null id is
    ordered first.  Columns of ``docs`` that bear a result's name are replaced.
    """
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    keyed = docs.select(
        F.struct(*[c for c in docs.columns if c not in RESULTS]).alias("_row"), F.col("doc_id").alias("_id"), _source_key(F.col("source")).alias("_source"),
        words(F.col(text)).alias("_size"), F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint").alias("_key"), F.xxhash64(text).alias("_tie"))
    sized = materialize(keyed.select("_source", "_size", "_key"), "sizes")
    plan = materialize(source_plan(sized), "sources")
    in_range = F.floor(F.col("_key") / F.lit(KEY_SPAN) * F.col("ranges")).cast("bigint")
    ranges = sized.join(plan, "_source").groupBy("_source", in_range.alias("_range"), "rest").agg(F.sum("_size").alias("held"))
    past = F.sum("held").over(Window.partitionBy("_source").orderBy("_range"))
    cuts = ranges.withColumn("before", past - F.col("held")).filter("before <= rest and rest < before + held")
    cuts = cuts.select("_source", F.col("_range").alias("cut"), "before")
    ruled = materialize(plan.join(cuts, "_source", "left").withColumn("cut", F.coalesce("cut", F.lit(-1))), "cuts")
    # A source of size 0 has no cut; all its documents are empty.
    placed = keyed.join(ruled, "_source").withColumn("_range", in_range)
    base = F.col("epochs") * F.col("_size")

    def out(df: DataFrame, part: Column) -> DataFrame:
        return df.select("_row.*", F.col("_size").alias("size"), "source_size", "target", (base + part).alias("taken"))

    clear = placed.filter("_range <> cut")
    order = Window.partitionBy("_source", "_range").orderBy("_key", "_id", "_size", "_tie")
    ahead = F.col("before") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size")
    edge = placed.filter("_range = cut").withColumn("_ahead", ahead)
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("_size"), F.col("rest") - F.col("_ahead")))
    return out(clear, F.when(F.col("_range") < F.col("cut"), F.col("_size")).otherwise(F.lit(0).cast("bigint"))).unionByName(out(edge, part))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each repeated taken/size times, rounded to whole documents (half up).

    Columns are those of ``docs``.  Rounding moves a source by less than one document, at its cut.
    """
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "source", "text")
    repeated = mix(packed).filter("size > 0 and taken > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), times))).filter("_copy > 0")
    return repeated.select("_doc.*")


#: DuckDB statement of ``mix`` over documents.
SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12) AS k
  FROM documents),
per AS (
  SELECT sk, sum(size)::BIGINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY sk) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY sk),
capped AS (SELECT *, (3 * source_size)::DOUBLE AS cap FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
targets AS (SELECT *, least(cap, max(level) OVER () * weight) AS target FROM levels),
budgets AS (SELECT *, least(floor(target + 0.5)::BIGINT, 3 * source_size) AS budget FROM targets),
rests AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs,
                 CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END AS rest FROM budgets),
ordered AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.epochs, r.rest,
         sum(s.size) OVER (PARTITION BY s.sk ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS ahead
  FROM sized s JOIN rests r USING (sk))
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM ordered
"""
