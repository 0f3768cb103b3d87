"""Model queries: every classifier and evaluation protocol on the training rows."""

from functools import reduce

from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.operators import models as M
from rasterloom.operators import sampling as K
from rasterloom.operators import shapes as H
from rasterloom.operators import regions as G
from rasterloom.operators import runs as R
from rasterloom.plans.regions import grid_pixels, labelled
from rasterloom.plans.registry import query
from rasterloom.session import materialize
from rasterloom.sources import tables as T

COLS = ["f1", "f2", "f3", "f4"]
ROUNDED = ("iou", "precision", "recall", "fpr")


def training_rows(spark, root):
    """Rows with a feature vector, unscaled; the label (unit price above 1500) is for the features to find.

    A fifth of the images is the test side.  The rows lie in as many files as the cluster has cores, since a fit reads a
    file (or 128 MB of one) in one task and a small table would else be one file.  They are shuffled only if the scan's own
    tasks are too few or too uneven; counting those reads no column.
    """
    cores = spark.sparkContext.defaultParallelism
    r = T.rows(spark, root)
    held = [p["count"] for p in r.groupBy(F.spark_partition_id()).count().collect()]
    r = r.withColumn("label", (F.col("f2") / F.col("f1") > 1500).cast("int"))
    z = M.assemble(r, COLS).select("row_key", "image_id", "label", "features", F.lit(1.0).alias("weight"))
    z = z.withColumn("fold", F.pmod(F.xxhash64("image_id"), F.lit(5)).cast("int"))
    even = len(held) >= cores and max(held) * cores <= 2 * sum(held)
    return materialize(z if even else z.repartition(cores, "row_key"), "rows")


def split(rows):
    return rows.filter("fold <> 0"), rows.filter("fold = 0")


def tidy(df, *keys):
    return df.select(*keys, "n", *[S.r6(c).alias(c) for c in ROUNDED])


def fit_and_score(spark, root, name):
    train, test = split(training_rows(spark, root))
    return tidy(M.evaluate(M.score(M.estimators(4)[name].fit(train), test), ["image_id"]), "image_id")


@query("l02_perceptron")
def perceptron(spark, root):
    return fit_and_score(spark, root, "mlp")


@query("l03_gradient_boosting")
def gradient_boosting(spark, root):
    return fit_and_score(spark, root, "hgb")


@query("l04_forest")
def forest(spark, root):
    return fit_and_score(spark, root, "forest")


@query("l04_forest_without_bootstrap")
def forest_without_bootstrap(spark, root):
    return fit_and_score(spark, root, "extra_trees")


@query("l05_logistic_and_tree")
def logistic_and_tree(spark, root):
    train, _ = split(training_rows(spark, root))
    est = M.estimators(4)
    text = [("logistic", M.logistic_equation(est["logistic"].fit(train), COLS)), ("tree3", est["tree3"].fit(train).stages[-1].toDebugString.split("\n", 1)[1])]
    return spark.createDataFrame(text, "model string, rule string")


@query("l06_mixture_split")
def mixture_split(spark, root):
    """Grid regions split into two components by shape and strength, with force-keep rules."""
    lb = materialize(labelled(spark, root), "regions")
    p = G.region_props(lb).filter("area >= 3")
    ves = R.to_pixels(lb, "region_id").join(grid_pixels(spark, root).select("image_id", "y", "x", "p"), ["image_id", "y", "x"]).groupBy(*G.KEY).agg(
        F.avg("p").alias("vesselness"))
    hull = H.hull_areas(G.keep_regions(lb, p))
    minor = F.when(F.col("minor") > 0, F.col("minor")).otherwise(0.5)
    cand = p.join(ves, G.KEY).join(hull, G.KEY).select(
        "image_id", F.col("region_id").alias("label"), "area", "major", (F.col("major") / minor).alias("elongation"),
        (F.col("area") / F.col("hull_area")).alias("solidity"), "ecc", "extent", "vesselness")
    out = M.mixture_split(cand, ["area", "major", "elongation", "solidity", "ecc", "extent", "vesselness"], keep_length=40, keep_area=60)
    return out.withColumn("crack_probability", F.round("crack_probability", 4))


@query("l07_batch_scoring")
def batch_scoring(spark, root):
    rows = training_rows(spark, root)
    model = pair().fit(split(rows)[0])
    return model.score(rows).select("row_key", F.round("p", 4).alias("p"))


@query("l09_column_subset")
def column_subset(spark, root):
    rows = VectorSlicer(inputCol="features", outputCol="some", indices=[2, 3]).transform(training_rows(spark, root)).drop("features").withColumnRenamed("some", "features")
    train, test = split(rows)
    return tidy(M.evaluate(M.score(M.estimators(2)["logistic"].fit(train), test), ["image_id"]), "image_id")


def logistic():
    return M.estimators(4)["logistic"]


def pair():
    """The deployed pair: one perceptron on two features, one on all four."""
    return M.Pair([0, 1], 4)


def cross_validated(spark, root, folds_of, make=logistic):
    rows = training_rows(spark, root).drop("fold")
    return M.cross_validate(rows, folds_of(rows), "image_id", ["row_key"], make)


@query("l10_grouped_cross_validation")
def grouped_cross_validation(spark, root):
    out = M.summarize_folds(cross_validated(spark, root, lambda r: K.grouped_folds(r, "image_id", M.MAX_FOLDS), pair))
    return out.select("k", *[S.r6(c).alias(c) for c in ("mean_iou", "std_iou", "min_iou", "mean_precision", "mean_recall")])


@query("l13_leak_check")
def leak_check(spark, root):
    rows = training_rows(spark, root).drop("fold")
    a = M.summarize_folds(M.cross_validate(rows, K.grouped_folds(rows, "image_id", 4), "image_id", ["row_key"], logistic)).withColumn("split", F.lit("grouped"))
    b = M.summarize_folds(M.cross_validate(rows, M.random_folds(rows, "row_key", 4), "row_key", ["row_key"], logistic)).withColumn("split", F.lit("random"))
    return a.unionByName(b).select("split", "k", S.r6("mean_iou").alias("mean_iou"), S.r6("std_iou").alias("std_iou"))


@query("l11_leave_one_image_out")
def leave_one_image_out(spark, root):
    """Eight-vector label groups of ``embeddings`` stand for images: each label is held out once."""
    e = T.table(spark, root, "embeddings").select(F.col("vec_id").alias("row_key"), F.col("label").alias("image_id"), "embedding")
    r = e.select("row_key", "image_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
                 (F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v) > 0).cast("int").alias("label"))
    rows = r.select("row_key", "image_id", "label", "features")
    folds = rows.select("image_id").distinct().withColumn("fold", F.col("image_id"))
    return tidy(M.evaluate(M.cross_validate(rows, folds, "image_id", ["row_key"], lambda: M.estimators(64)["logistic"]), ["fold"]), "fold")


@query("l12_leave_one_group_out")
def leave_one_group_out(spark, root):
    """Suppliers' regions stand for specimen groups: each is held out once."""
    home = T.table(spark, root, "supplier").join(T.table(spark, root, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    folds = home.select(F.col("s_suppkey").alias("image_id"), F.col("n_regionkey").alias("fold"))
    return tidy(M.evaluate(cross_validated(spark, root, lambda r: folds), ["fold"]), "fold")


@query("l14_learning_curve")
def learning_curve(spark, root):
    train, test = split(training_rows(spark, root))
    return tidy(M.learning_curve(train, test, (20, 100, 400), ["row_key"], logistic), "size")


@query("l15_self_training")
def self_training(spark, root):
    """One fold is labelled, the clean rows of another watch for false calls, and all other rows are the pool."""
    rows = training_rows(spark, root)
    watched = (F.col("fold") == 0) & (F.col("label") == 0)
    out = M.self_training(rows.filter("fold = 1"), rows.filter((F.col("fold") != 1) & ~watched), rows.filter(watched), ["row_key"], logistic, generations=2)
    return out.withColumn("clean_fp", S.r6("clean_fp"))


@query("l16_balance_sweep")
def balance_sweep(spark, root):
    train, test = split(training_rows(spark, root))
    return tidy(M.balance_sweep(train, test, 60, ["row_key"], logistic), "neg_cap")


@query("f14_feature_importance")
def feature_importance(spark, root):
    """Importance by feature family, averaged over the fits of all folds."""
    rows = training_rows(spark, root)
    models = M.fit_all([(lambda: M.estimators(4)["forest"], rows.filter(F.col("fold") != f)) for f in range(M.MAX_FOLDS)])
    parts = [M.importance_table(m, COLS, {"f1": "size", "f2": "size", "f3": "rate", "f4": "rate"}).groupBy("family").agg(F.sum("importance").alias("i")) for m in models]
    return reduce(DataFrame.union, parts).groupBy("family").agg(F.round(F.avg("i"), 4).alias("importance"))


@query("r09_three_axis_table")
def three_axis_table(spark, root):
    """Per architecture: truth IoU on held-out rows and area called on clean rows."""
    rows = training_rows(spark, root)
    train, test = split(rows)
    out = None
    for name in ("logistic", "tree3", "forest"):
        s = materialize(M.score(M.estimators(4)[name].fit(train), test).select("label", "p", F.lit(name).alias("model")), "scored")  # read twice below
        part = materialize(M.evaluate(s, ["model"]).join(s.filter("label = 0").groupBy("model").agg(F.avg((F.col("p") > 0.5).cast("int")).alias("clean_area")), "model"), "axes")
        out = part if out is None else out.union(part)
    return out.select("model", S.r6("iou").alias("iou"), S.r6("clean_area").alias("clean_area")).orderBy(F.desc("iou"))


@query("r10_head_control")
def head_control(spark, root):
    """The same head on each feature block: what the features add, apart from the head."""
    rows, out = training_rows(spark, root), None
    for name, idx in (("size", [0, 1]), ("rate", [2, 3]), ("all", [0, 1, 2, 3])):
        r = VectorSlicer(inputCol="features", outputCol="some", indices=idx).transform(rows).drop("features").withColumnRenamed("some", "features")
        train, test = split(r)
        part = materialize(M.evaluate(M.score(M.estimators(len(idx))["logistic"].fit(train), test).withColumn("block", F.lit(name)), ["block"]), "head")
        out = part if out is None else out.union(part)
    return tidy(out, "block")


@query("e05_candidates_by_label", "rows", """, c AS (SELECT image_id, count(*) AS n, avg(f1) AS f FROM rows_ GROUP BY 1), h AS (SELECT s_suppkey AS image_id, s_acctbal > 5000 AS is_pos FROM supplier)
    SELECT image_id, n, round(f, 6) AS f, is_pos FROM c JOIN h USING (image_id)""")
def candidates_by_label(spark, root):
    """Candidates joined to hand labels; fewer than ten matches are an error."""
    c = T.rows(spark, root).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), S.r6(F.avg("f1")).alias("f"))
    h = T.table(spark, root, "supplier").select(F.col("s_suppkey").alias("image_id"), (F.col("s_acctbal") > 5000).alias("is_pos"))
    j = c.join(h, "image_id")
    enough = j.agg(F.assert_true(F.count(F.lit(1)) >= 10, "fewer than ten labelled candidates match")).scalar()
    return j.filter(enough.isNull())
