import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import metrics as M
from rasterloom.operators import ordered as O
from rasterloom.operators import quantiles as Q
from rasterloom.operators import sampling as K


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    hot = rng.lognormal(size=5000)
    return pd.DataFrame({"k": ["hot"] * 5000 + ["flat"] * 40 + ["one"] + ["ties"] * 99,
                         "v": np.concatenate([hot, np.full(40, 2.5), [7.0], rng.integers(0, 3, 99).astype(float)])})


def test_percentiles_match_linear_interpolation(spark, skewed):
    probs = {"a": 0.01, "b": 0.5, "c": 0.99, "lo": 0.0, "hi": 1.0}
    got = {r.k: r for r in Q.exact_percentiles(spark.createDataFrame(skewed), ["k"], "v", probs, bins=16).collect()}
    assert set(got) == set(skewed.k)
    for k, part in skewed.groupby("k"):
        for name, q in probs.items():
            assert got[k][name] == pytest.approx(np.percentile(part.v, 100 * q), abs=1e-12)
    whole = Q.exact_percentiles(spark.createDataFrame(skewed), [], "v", {"m": 0.5}).first()
    assert whole.m == pytest.approx(np.median(skewed.v))


def test_percentiles_ignore_null_and_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0)], "k string, v double")
    assert Q.exact_percentiles(df, ["k"], "v", {"m": 0.5}).first().m == 2.0


@pytest.mark.parametrize("cap", [0, 1, 37, 4000, 99999])
def test_hash_cap_is_exact(spark, cap):
    df = spark.range(6000).withColumn("g", F.when(F.col("id") < 5000, "hot").otherwise("cold"))
    got = K.take_by_hash(df, ["g"], K.hash_order("s", "id"), cap).toPandas()
    ranked = df.withColumn("h", K.hash_order("s", "id")).toPandas()
    want = set(ranked.sort_values("h").groupby("g").head(cap).id)
    assert set(got.id) == want and len(got) == len(want)


def test_folds_never_split_a_group_and_stay_even(spark):
    df = spark.range(3000).withColumn("g", F.floor(F.sqrt("id")).cast("long"))  # groups of 1, 3, 5, ... rows
    f = K.grouped_folds(df, "g", 5).toPandas()
    assert len(f) == 55 and f.g.is_unique and f.fold.between(0, 4).all()
    load = f.groupby("fold").n.sum()
    assert load.max() - load.min() <= 2 * f.n.max()
    assert f.groupby("fold").size().max() == 11


def test_a_missing_value_is_passed_over(spark):
    df = spark.createDataFrame([(i, float(i) if i % 4 == 0 else None) for i in range(30)], "t int, v double")
    prev = O.previous_value(df, [], F.floor(F.col("t") / 5), ["t"], "v").toPandas().sort_values("t")
    want = df.toPandas().sort_values("t").v.ffill().shift(1)
    assert np.allclose(prev.previous.to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_ordered_helpers_match_one_partition(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 400, p=[0.9, 0.1]), "t": np.arange(400), "v": rng.normal(size=400)})
    df = spark.createDataFrame(pdf)
    prev = O.previous_value(df, ["k"], F.floor(F.col("t") / 7), ["t"], "v").toPandas().sort_values("t")
    want = pdf.sort_values("t").groupby("k").v.shift(1)
    assert np.allclose(prev.previous.to_numpy(float), want.to_numpy(float), equal_nan=True)
    run = O.running_total(df, ["k"], F.floor(F.col("t") / 11), [F.asc("t")], {"s": "v"}).toPandas().sort_values("t")
    assert np.allclose(run.s, pdf.sort_values("t").groupby("k").v.cumsum())
    slid = O.sliding(df.filter("k = 'a'"), ["k"], "t", 3, 2, {"s": F.sum("v")}, block=8).toPandas().set_index("t")
    a = pdf[pdf.k == "a"].set_index("t").v
    for t in a.index:
        assert slid.loc[t].s == pytest.approx(a[(a.index >= t - 3) & (a.index <= t + 2)].sum())


def test_roc_area_counts_ties_half(spark):
    rng = np.random.default_rng(1)
    p, y = rng.integers(0, 8, 300) / 8, rng.random(300) < 0.4
    df = spark.createDataFrame(pd.DataFrame({"k": "x", "p": p, "y": y}))
    auc = M.threshold_free(df, ["k"], "p", F.col("y")).first().auc
    pos, neg = p[y], p[~y]
    assert auc == pytest.approx(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([("x", 0.3, True), ("x", 0.7, True)], "k string, p double, y boolean")
    assert M.threshold_free(df, ["k"], "p", F.col("y")).first().auc is None


def test_sign_test_small_sample(spark):
    df = spark.createDataFrame([("x", d) for d in (1.0, 2.0, 3.0, 0.5, 0.0)], "k string, delta double")
    r = M.sign_test(df, ["k"]).first()
    assert (r.wins, r.n_nonzero, r.p_sign) == (4, 4, 0.125)


def test_wilcoxon_with_ties_and_with_many_pairs(spark):
    d = [0.3, -0.3, 0.3, 0.7, -0.2, 0.7, -0.2, 0.0]
    r = M.wilcoxon(spark.createDataFrame([("x", v) for v in d], "k string, delta double"), ["k"]).first()
    a = np.abs([v for v in d if v])
    ranks = np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])
    plus = ranks[np.array([v for v in d if v]) > 0].sum()
    stat = min(plus, ranks.sum() - plus)
    sums = [sum(k for k, b in zip(ranks, f"{i:07b}") if b == "1") for i in range(128)]
    assert r.n == 7 and r.statistic == stat and r.p_wilcoxon == pytest.approx(min(1, 2 * sum(s <= stat for s in sums) / 128))
    many = [("x", float(v)) for v in np.random.default_rng(1).normal(0.03, 1, 2000).round(2)]
    frame = spark.createDataFrame(many, "k string, delta double")
    exact, normal = (M.wilcoxon(frame, ["k"], method=m).first() for m in ("exact", "normal"))
    assert exact.statistic == normal.statistic and exact.p_wilcoxon == pytest.approx(normal.p_wilcoxon, abs=2e-3)


def test_fragments_with_one_beginning_in_common(spark):
    from rasterloom.operators import labels as L

    names = [(i, f"SPECIMEN_{i:03d}_scan") for i in range(60)] + [(100, "ab"), (101, "")]
    fragments = ["specimen_017", "Specimen_059_SCAN", "specimen", "ab", "b", "specimen_777", "", "n_00"]
    got = {r.fragment: (r.image_id, r.n_matches) for r in L.fragment_match(
        spark.createDataFrame([(f,) for f in fragments], "fragment string"), spark.createDataFrame(names, "image_id long, name string")).collect()}
    want = {f: [i for i, n in names if f.lower() in n.lower()] for f in fragments if f}
    assert got == {f: (min(v), len(v)) for f, v in want.items() if v}


def test_wilcoxon_by_enumeration(spark):
    d = [0.3, -0.1, 0.5, 0.7, -0.2, 0.9]
    r = M.wilcoxon(spark.createDataFrame([("x", v) for v in d], "k string, delta double"), ["k"]).first()
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    stat = min(ranks[np.array(d) > 0].sum(), ranks[np.array(d) < 0].sum())
    sums = [sum(k for k, b in zip(ranks, f"{i:06b}") if b == "1") for i in range(64)]
    assert r.statistic == stat and r.p_wilcoxon == pytest.approx(2 * sum(s <= stat for s in sums) / 64)


def test_corrected_rows_and_their_columns(spark):
    """All positives up to the cap, negatives up to the balance point; vectors are features, then the interpolated grid."""
    from pyspark.ml.functions import vector_to_array

    from rasterloom.operators import retrain as R

    labels = [(f, y, x, 1 if (y, x) < (0, 3 + f) else 2) for f in range(2) for y in range(4) for x in range(4)]
    df = spark.createDataFrame([(str(f), y, x, s) for f, y, x, s in labels], "image_id string, y int, x int, state int")
    got = R.corrected_rows(df, "t", per_frame=3, floor=1).collect()
    count = lambda f, v: sum(r["image_id"] == f and r["label"] == v for r in got)
    assert [count(f, v) for f in "01" for v in (1, 0)] == [3, 3, 3, 3]  # six positives within the cap over two frames
    assert {(r["image_id"], r["y"], r["x"], r["label"]) for r in got} <= {(str(f), y, x, int(s == 1)) for f, y, x, s in labels}
    px = df.select("image_id", "y", "x", (F.col("y") * 10.0).alias("a"), (F.col("x") * 1.0).alias("b"))
    grid = [float(c * 100 + i * 10 + j) for c in range(3) for i in range(2) for j in range(2)]
    tiles = spark.createDataFrame([("0", 0, 0, 0, 3, 2, 2, grid)], "image_id string, tile_ord int, y0 int, x0 int, c int, gy int, gx int, e array<double>")
    marked = df.select("image_id", "y", "x", (F.col("state") == 1).cast("int").alias("label"))
    rows = R.hybrid_rows(marked, px, ["a", "b"], tiles, 4, 2.0).select("image_id", "y", "x", vector_to_array("features").alias("f")).collect()
    assert len(rows) == 16 and {r["image_id"] for r in rows} == {"0"}  # a frame without an embedding has not the width
    for r in rows:
        i, j = (min(max(v / 2 - 0.5, 0), 1) for v in (r["y"], r["x"]))
        assert r["f"] == pytest.approx([r["y"] * 10.0, r["x"], *[c * 100 + i * 10 + j for c in range(3)]])


def test_nested_samples_are_cut_from_one_ranking(spark):
    """A row's rank in digest order gives every smaller cap's rows, and a cap without keys shuffles no row past the cut."""
    df = spark.range(3000).selectExpr("id AS row_key", "id % 7 AS image_id", "CAST(id % 5 = 0 AS INT) AS label")
    ranked = K.take_by_hash(df, ["image_id", "label"], K.hash_order("curve", "row_key"), 200, "_rank").localCheckpoint()
    for n in (1, 20, 200):
        want = {r.row_key for r in K.stratified_cap(df, n, "curve", ["row_key"]).collect()}
        assert {r.row_key for r in ranked.filter(F.col("_rank") <= n).collect()} == want
    few = K.take_by_hash(df, [], K.hash_order("train", "row_key"), 50)
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    order = {r.row_key for r in df.orderBy(K.hash_order("train", "row_key")).limit(50).collect()}
    assert {r.row_key for r in few.collect()} == order


@pytest.mark.parametrize("n", [30, 211, 20011])
def test_spectra_equal_sums_over_the_line(spark, n):
    from rasterloom.operators import periodic as P

    pos = np.arange(n)
    v = 1 + 0.3 * np.cos(2 * np.pi * pos / 10) + 0.1 * np.random.default_rng(n).random(n)
    profile = spark.createDataFrame(pd.DataFrame({"image_id": "a", "pos": pos.astype("int32"), "n": np.int32(n), "v": v}))
    got = P.spectra(profile, ["image_id"], 25).toPandas()
    assert len(got) == 3 * (n // 2 + 1)
    for win, width in enumerate((15, 25, 41)):
        width = min(width, (n // 2) | 1)
        base = np.convolve(np.pad(v, width // 2), np.ones(width), "valid") / width
        rel = (v - base) / np.maximum(np.abs(base), 1e-9)
        mine = got[got["win"] == win].set_index("k")["mag"]
        for k in (0, 1, n // 10, n // 2):
            assert mine[k] == pytest.approx(abs(np.sum(rel * np.exp(-2j * np.pi * (k * pos % n) / n))), abs=1e-8)
    found = P.stable_period(profile, ["image_id"], F.lit(6), F.lit(40), 25).first()
    assert found.period == pytest.approx(10, rel=0.05) if n > 30 else True


def test_frames_of_one_name_are_matched_once(spark):
    from rasterloom.operators import labels as L

    names = spark.range(1, 5001).selectExpr("id AS image_id", "concat('Plate_', id % 3) AS name")
    out = L.fragment_match(spark.createDataFrame([("plate",), ("E_2",), ("x",)], "fragment string"), names)
    assert {tuple(r) for r in out.collect()} == {("plate", 1, 5000), ("E_2", 2, 1667)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Generate") < plan.rindex("Aggregate")  # names are grouped before their grams are cut


def test_training_rows_keep_every_core_busy(spark):
    from rasterloom.plans import models as P
    from rasterloom.sources import tables as T

    root = "/root/testdata/sf0.01"
    rows = P.training_rows(spark, root)
    filled = rows.groupBy(F.spark_partition_id()).count().count()
    assert filled >= spark.sparkContext.defaultParallelism  # one file of one row group is read by a single task
    assert rows.count() == T.table(spark, root, "lineitem").count()
