"""Pixel classifiers on MLlib: factories, grouped evaluation protocols, sweeps and self-training.

Scores follow the reference's protocol, not its numbers: MLlib's perceptron is sigmoid with
L-BFGS and takes no row weights, and there are no extra trees (a forest without bootstrap
stands in for them).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.aggregates import confusion
from rasterloom.operators.cells import Boosting, Ensemble, Forest
from rasterloom.operators.metrics import overlap_scores
from rasterloom.operators.perceptron import Perceptron
from rasterloom.operators.sampling import hash_order, take_by_hash
from rasterloom.session import materialize, scratch_dir

SEED = 0
MAX_FOLDS = 5
FOREST_MB = 512  # statistics of the nodes that one pass over the rows splits
AT_ONCE = 5  # fits that run side by side
MLP_TOLERANCE = 1e-4  # stands in for early stopping, which MLlib's perceptron has not


def scaled(estimator: Estimator) -> Pipeline:
    """The estimator behind a scaler that is fitted with it, so on the training rows only."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, estimator.setFeaturesCol("scaled")])


def estimators(n_features: int, weight: str | None = None, max_iter: int = 300) -> dict[str, Pipeline | Forest | Boosting | Perceptron]:
    """The single registry of architectures, by name; ``max_iter`` is that of the perceptrons.

    Without weights, tree ensembles are grown on counted cells.  Perceptrons take none.
    """
    w = {"weightCol": weight} if weight else {}
    forest = {"numTrees": 200, "maxDepth": 12, "maxMemoryInMB": FOREST_MB, "seed": SEED, "labelCol": "label", **w}
    plain = {name: scaled(e) for name, e in {
        "hgb": GBTClassifier(maxIter=100, maxDepth=5, seed=SEED, labelCol="label", **w),
        "forest": RandomForestClassifier(**forest),
        "extra_trees": RandomForestClassifier(bootstrap=False, featureSubsetStrategy="sqrt", **forest),
        "logistic": LogisticRegression(maxIter=100, labelCol="label", **w),
        "tree3": DecisionTreeClassifier(maxDepth=3, seed=SEED, labelCol="label", **w),
    }.items()}
    plain["mlp"], plain["hybrid_mlp"] = (Perceptron([n_features, *hidden, 2], max_iter, MLP_TOLERANCE, SEED) for hidden in ((64, 32), (128, 64)))
    if weight:
        return plain
    return {**plain, "forest": Forest(plain["forest"], 200, 12, SEED), "extra_trees": Forest(plain["extra_trees"], 200, 12, SEED, bootstrap=False),
            "hgb": Boosting(plain["hgb"], 100, 5, SEED)}


def assemble(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows)


def standardize(rows: DataFrame, columns: Sequence[str], train: Column | None = None) -> DataFrame:
    """Scale by mean and population deviation of the training rows; the statistics are one row."""
    src = rows if train is None else rows.filter(train)
    stats = src.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    out = {}
    for c in columns:
        sd = stats[f"s_{c}"] or 1.0
        out[c] = (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(sd)
    return rows.withColumns(out)


def score(model: Transformer, rows: DataFrame) -> DataFrame:
    """Adds ``p``, the probability of the positive class, in one narrow pass."""
    if isinstance(model, Ensemble):
        return model.score(rows)
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "scaled")


def ensemble_score(models: dict[str, tuple[Transformer, Sequence[int] | None]], rows: DataFrame) -> DataFrame:
    """Mean probability of several models, each on its own feature subset."""
    out = rows.withColumnRenamed("features", "_all")
    for name, (model, subset) in models.items():
        fed = (VectorSlicer(inputCol="_all", outputCol="features", indices=list(subset)).transform(out) if subset is not None
               else out.withColumn("features", F.col("_all")))
        out = score(model, fed).withColumnRenamed("p", f"p_{name}").drop("features")
    mean = sum(F.col(f"p_{n}") for n in models) / len(models)
    return out.withColumn("p", mean).withColumnRenamed("_all", "features")


def evaluate(scored: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Fold-table scores per key."""
    t = F.col("label") == 1
    c = overlap_scores(confusion(scored, keys, F.col("p") > threshold, t), empty=0.0)
    return c.select(*keys, (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), "iou", "precision", "recall",
                    (F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))).alias("fpr"))


class Pair:
    """The deployed architecture: a model on a subset of the features and one on all, by mean probability.

    The model on all features is of architecture ``whole``, by default that of the other.
    """

    def __init__(self, subset: Sequence[int], n_features: int, name: str = "mlp", whole: str | None = None, max_iter: int = 300):
        self.subset, self.n_features, self.name, self.whole, self.max_iter = list(subset), n_features, name, whole or name, max_iter

    def fit(self, rows: DataFrame) -> "FittedPair":
        some = VectorSlicer(inputCol="features", outputCol="_some", indices=self.subset).transform(rows).drop("features").withColumnRenamed("_some", "features")
        of = lambda name, n: lambda: estimators(n, max_iter=self.max_iter)[name]
        first, second = fit_all([(of(self.name, len(self.subset)), some), (of(self.whole, self.n_features), rows)])
        return FittedPair({"subset": (first, self.subset), "all": (second, None)})


class FittedPair:
    def __init__(self, models):
        self.models = models

    def score(self, rows: DataFrame) -> DataFrame:
        return ensemble_score(self.models, rows).drop(*[f"p_{n}" for n in self.models])


def score_with(model, rows: DataFrame) -> DataFrame:
    """Probability of the positive class by a fitted pipeline or pair."""
    return model.score(rows) if isinstance(model, FittedPair) else score(model, rows)


def fit_all(jobs: Sequence[tuple[Callable[[], Estimator | Pair], DataFrame]]) -> list:
    """Fitted models of several (architecture, training rows), side by side: small fits leave most of a cluster idle."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    if not jobs:
        return []
    fit = inheritable_thread_target(jobs[0][1].sparkSession)(lambda job: job[0]().fit(job[1]))
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(fit, jobs))


def cross_validate(rows: DataFrame, folds: DataFrame, group: str, ident: Sequence[str], make: Callable[[], Estimator | Pair],
                   on_fold: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """One refit per fold on rows that share no group with the test rows; returns the scored test rows of all folds.

    ``folds`` maps a group to its fold.  A fit reads all rows of the other folds, which lie in a file per core; every test row
    is scored.  Scored rows go to one table partitioned by fold, and ``on_fold`` sees each fold's.
    """
    spark = rows.sparkSession
    tagged = rows.join(folds.select(group, "fold"), group)
    tagged = materialize(tagged.repartition(spark.sparkContext.defaultParallelism, *ident), "folds")
    path = f"{scratch_dir(spark)}/scored-{uuid.uuid4().hex}"
    schema = None
    folds_of = [r["fold"] for r in tagged.select("fold").distinct().orderBy("fold").collect()]
    trains = [tagged.filter(F.col("fold") != f) for f in folds_of]
    for f, model in zip(folds_of, fit_all([(make, t) for t in trains])):
        part = score_with(model, tagged.filter(F.col("fold") == f)).drop("features")
        schema = part.schema
        part.write.mode("append").partitionBy("fold").parquet(path)
        if on_fold:
            on_fold(f, spark.read.schema(schema).parquet(path).filter(F.col("fold") == f))
    return spark.read.schema(schema).parquet(path) if schema else tagged.drop("features").withColumn("p", F.lit(None).cast("double"))


def summarize_folds(scored: DataFrame) -> DataFrame:
    """Mean, sample deviation and worst fold, one row."""
    per = evaluate(scored, ["fold"])
    return per.agg(F.count(F.lit(1)).alias("k"), F.avg("iou").alias("mean_iou"), F.coalesce(F.stddev_samp("iou"), F.lit(0.0)).alias("std_iou"),
                   F.min("iou").alias("min_iou"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"))


def random_folds(rows: DataFrame, ident: str, k: int) -> DataFrame:
    """Fold per row instead of per group: the leaking split, kept to measure the leak."""
    return rows.select(ident, F.pmod(F.xxhash64(ident), F.lit(k)).cast("int").alias("fold"))


def importance_table(model, names: Sequence[str], families: dict[str, str] | None = None) -> DataFrame:
    """Feature importances, one row per feature; the model holds one number per feature."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = [(n, float(v), (families or {}).get(n, n.split("_")[0])) for n, v in zip(names, model.stages[-1].featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double, family string")


def logistic_equation(model, names: Sequence[str]) -> str:
    fit = model.stages[-1]
    terms = " ".join(f"{'+' if c >= 0 else '-'} {abs(c):.4f}*z({n})" for c, n in zip(fit.coefficients.toArray(), names))
    return f"logit(p) = {fit.intercept:.4f} {terms}"


def mixture_split(cand: DataFrame, features: Sequence[str], keep_length: float = 150, keep_area: float = 50_000) -> DataFrame:
    """Two-component mixture over standardised candidate features; the more crack-like component is positive.

    Long or very large candidates are kept whatever their component.
    """
    z = assemble(standardize(cand, features), features).select("image_id", "label", "features")
    z = z.join(cand.select("image_id", "label", *[F.col(c).alias(f"raw_{c}") for c in features]), ["image_id", "label"])
    z = materialize(z, "mixture")
    model = GaussianMixture(k=2, seed=SEED, featuresCol="features").fit(z)
    got = materialize(model.transform(z).withColumn("_p", vector_to_array("probability")).drop("features", "probability"), "components")
    per = got.groupBy("prediction").agg((F.avg("raw_elongation") + 5 * F.avg("raw_vesselness") - F.avg("raw_solidity")).alias("s"))
    crack = per.agg(F.max_by("prediction", "s")).scalar()
    forced = (F.col("raw_major") >= keep_length) | (F.col("raw_area") >= keep_area)
    return got.select("image_id", "label", F.get("_p", crack).alias("crack_probability"), ((F.col("prediction") == crack) | forced).alias("is_crack"), forced.alias("forced"))


def learning_curve(rows: DataFrame, test: DataFrame, sizes: Sequence[int], ident: Sequence[str], make: Callable[[], Estimator]) -> DataFrame:
    """Scores for growing caps per frame and class, on one fixed test set.

    The samples are nested, so rows are ranked once, at the largest cap.
    """
    out = None
    ranked = take_by_hash(rows, ["image_id", "label"], hash_order("curve", *ident), max(sizes, default=0), "_rank")
    ranked = materialize(ranked, "ranked")
    for n in sizes:
        train = ranked.filter(F.col("_rank") <= n).drop("_rank")
        e = materialize(evaluate(score(make().fit(train), test).withColumn("size", F.lit(n)), ["size"]), "curve")
        out = e if out is None else out.union(e)
    return out


def balance_sweep(rows: DataFrame, test: DataFrame, centre: int, ident: Sequence[str], make: Callable[[], Estimator],
                  factors: Sequence[float] = (0.5, 1.0, 1.5, 2.0)) -> DataFrame:
    """Scores for negative caps around the balance point; rows are ranked once, at the largest cap."""
    out = None
    caps = [max(1, int(centre * f)) for f in factors]
    most = F.when(F.col("label") == 1, centre).otherwise(max(caps, default=0))
    ranked = materialize(take_by_hash(rows.filter("label IN (0, 1)"), ["image_id", "label"], hash_order("sweep", *ident), most, "_rank"), "ranked")
    for cap in caps:
        train = ranked.filter((F.col("label") == 1) | (F.col("_rank") <= cap)).drop("_rank")
        e = materialize(evaluate(score(make().fit(train), test).withColumn("neg_cap", F.lit(cap)), ["neg_cap"]), "sweep")
        out = e if out is None else out.union(e)
    return out


def self_training(labelled: DataFrame, pool: DataFrame, clean: DataFrame, ident: Sequence[str], make: Callable[[], Estimator], generations: int = 3,
                  hi: float = 0.8, lo: float = 0.2, per_class: int = 1000) -> DataFrame:
    """Each generation adds equally many confident pool rows of both classes and reports the share called positive on clean rows."""
    train, out = labelled, None
    for g in range(generations + 1):
        model = make().fit(train)
        fp = score(model, clean).agg(F.avg((F.col("p") > 0.5).cast("int")).alias("clean_fp"))
        size = train.agg(F.count(F.lit(1)).alias("n_train"))
        row = materialize(fp.select(F.lit(g).alias("generation"), "clean_fp", size.scalar().alias("n_train")), "generation")
        out = row if out is None else out.union(row)
        if g == generations:
            break
        sure = score(model, pool).filter((F.col("p") >= hi) | (F.col("p") <= lo)).withColumn("label", (F.col("p") >= hi).cast("int"))
        n = sure.groupBy("label").count().agg(F.when(F.count(F.lit(1)) == 2, F.min("count")).otherwise(0)).scalar()
        added = take_by_hash(sure.withColumn("_n", F.least(n, F.lit(per_class))), ["label"], hash_order(f"self{g}", *ident), F.col("_n"))
        train = materialize(labelled.unionByName(added.select(labelled.columns)), "selftrain")
    return out

