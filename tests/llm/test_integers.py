"""Centroids and hard negatives against brute force in whole numbers."""

import hashlib
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import centroids, negatives
from rasterloom.llm.common import prepare

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def groups(n, dim, seed, kinds=6):
    rng = np.random.default_rng(seed)
    means = rng.normal(size=(kinds, dim))
    label = rng.integers(0, kinds, n)
    x = means[label] + 0.5 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))]


def bad(dim):
    return [(1001, None, 1), (1020, [float("nan")] + [1.0] * (dim - 1), 1), (1040, [float("inf")] + [1.0] * (dim - 1), 2), (1060, [None] + [1.0] * (dim - 1), 1),
            (1080, [], 1), (1100, [1.0, 2.0, 3.0], 1)]


def frame(spark, rows):
    prepare(spark)
    extra = {c: F.lit(1) for c in ("q", "cluster", "dim", "chunk", "anchor", "lead", "rest", "norm", "block", "place", "one", "score")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(extra).repartition(3)


def brute_clusters(rows, dim=64, k=16, rounds=3):
    q = [(i, [floor(64 * x) for x in e]) for i, e, _ in rows if e is not None and len(e) == dim and None not in e and np.isfinite(np.array(e, float)).all()]
    first = sorted(q, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(v) for _, v in first]
    for step in range(rounds + 1):
        given = []
        for i, v in q:
            d = [sum((a - b) ** 2 for a, b in zip(v, m)) for m in c]
            given.append((i, d.index(min(d)), min(d), v))
        if step < rounds:
            for j in range(len(c)):
                mine = [g[3] for g in given if g[1] == j]
                if mine:
                    c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    total = sum(g[2] for g in given)
    return sorted(((i, j, d, sum(g[2] for g in given if g[1] == j), total, digest[j]) for i, j, d, _ in given), key=str)


@pytest.mark.parametrize("kind", ["groups", "few", "copies", "long"])
def test_clusters(spark, kind):
    rows = {"groups": groups(300, 64, 1) + bad(64) + [(None, [0.0] * 64, None), (5, [0.25] * 64, 1), (5, [0.25] * 64, 1)], "few": groups(5, 64, 2),
            "copies": [(i, [0.5] * 64, 1) for i in range(40)], "long": groups(40, 64, 3) + [(900, [1e3] * 64, 1), (901, [-1e5] * 63 + [1e-300], 1)]}[kind]
    got = sorted(map(tuple, centroids.cluster(frame(spark, rows)).collect()), key=str)
    assert got == brute_clusters(rows)


def test_clusters_of_nothing_and_of_one(spark):
    empty = frame(spark, bad(64))
    assert centroids.cluster(empty).count() == 0 and centroids.cluster(empty.limit(0)).count() == 0
    one = centroids.cluster(frame(spark, [(3, [1.0] * 64, None)])).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in one] == [(3, 0, 0, 0)]
    huge = centroids.cluster(frame(spark, [(i, [(-1.0) ** i * 1e300] * 64, 1) for i in range(6)]), k=1).collect()
    assert len(huge) == 6 and all(0 <= r.distance <= r.cluster_inertia <= r.inertia for r in huge)


def test_the_bound_never_loses_and_spares_work():
    rng = np.random.default_rng(4)
    basis = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    q = np.floor(64 * (rng.normal(size=(2000, 6)) @ basis[:6] + 0.02 * rng.normal(size=(2000, 64)))).astype(np.int64)
    c = q[:16].copy()
    axes = np.linalg.eigh(np.cov(q.T))[1][:, ::-1]
    lead, rest = centroids.split(q.astype(float), axes, 16)
    best, distance, compared = centroids.nearest(q, lead, rest, c, axes)
    d = ((q[:, None] - c) ** 2).sum(2)
    assert np.array_equal(best, d.argmin(1)) and np.array_equal(distance, d.min(1))
    assert compared < 0.15 * d.size


def brute_negatives(rows, every=100, n_pos=5, n_neg=10, label=lambda i, k: k):
    once = {}
    for i, e, k in rows:
        if i is None or k is None or not e or None in e or not np.isfinite(np.array(e, float)).all():
            continue
        mine = (label(i, k), [floor(256 * x) for x in e])
        once[i] = min(once.get(i, mine), mine)
    out = []
    for a, (k, q) in once.items():
        if a % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(q, v)), i, kk) for i, (kk, v) in once.items() if i != a and len(v) == len(q))
        for ps, p, _ in [r for r in s if r[2] == k][:n_pos]:
            fits = [(i, -t) for t, i, kk in s if kk != k and 30 * -ps <= 100 * -t <= 90 * -ps][:n_neg]
            out += [(a, p, r, i, -ps, t) for r, (i, t) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,chunk", [(256, 8192), (4, 60)])
def test_negatives(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    rows = groups(400, 24, 5) + bad(24) + [(i, [0.2] * 24, i % 3) for i in range(2000, 2060)] + [(None, [1.0] * 24, 1), (7, [9.0] * 24, 0), (500, [0.0] * 24, 1), (600, [1.0] * 24, None)]
    rows += [(i, [float(i % 4), 1.0, 2.0], i % 2) for i in range(3000, 3012)]
    got = sorted(map(tuple, negatives.mine(frame(spark, rows), every=10).collect()))
    assert got == brute_negatives(rows, every=10) and len(got) > 1000


def test_labels_move_and_tables_may_be_empty(spark):
    rows = [r for r in groups(150, 16, 8)]
    moved = negatives.relabelled(F.col("vec_id"), F.col("label"))
    got = sorted(map(tuple, negatives.mine(frame(spark, rows), moved, every=5).collect()))
    assert got == brute_negatives(rows, every=5, label=lambda i, k: (k + 1) % 10 if i % 7 == 0 else k)
    assert negatives.mine(frame(spark, rows).limit(0)).count() == 0 and negatives.mine(frame(spark, bad(16))).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [1000.0 * ((i * j) % 17), 3e4, float(i)], i % 3) for i, j in zip(range(60), range(5, 65))]
    assert sorted(map(tuple, negatives.mine(frame(spark, rows), every=10).collect())) == brute_negatives([(i, [min(x, 2 ** 22 / 256) for x in e], k) for i, e, k in rows], every=10)


def test_tree_bounds_hold_and_spare_scores():
    rng = np.random.default_rng(9)
    hub = rng.normal(size=(3, 32))
    a = np.floor(256 * (np.repeat(hub, 20, axis=0) + 0.01 * rng.normal(size=(60, 32))))
    order = negatives.spanning_order(a)
    assert sorted(o[0] for o in order) == list(range(60)) and all(p < i for i, (_, p, _) in enumerate(order))
    weight = sum(o[2] for o in order)
    left, total = {0}, 0.0
    while len(left) < 60:
        d, j = min((float(np.linalg.norm(a[i] - a[j])), j) for i in left for j in range(60) if j not in left)
        left.add(j)
        total += d
    assert weight == pytest.approx(total)
    import pyarrow as pa

    x = np.floor(256 * rng.normal(size=(500, 32))).astype(np.int64)
    rows = [o[0] for o in order]
    block = pa.record_batch({"q": a[rows].astype(int).tolist(), "parent": pa.array([o[1] for o in order], pa.int32()), "edge": [o[2] for o in order]})
    ids, labels, got = np.arange(500), np.zeros(500, int), {}

    def take(i, at, score):
        got[i] = negatives.best_of(score, ids, at, 5).tolist()

    scored = negatives.walk(block, ids, labels, x, np.sqrt((x * x).sum(1).astype(float)), lambda i, lo, hi: negatives.positive_need(lo, hi, labels == 0, 5), take)
    exact = x @ a[rows].T.astype(int)
    assert all(got[i] == np.lexsort((ids, -exact[:, i]))[:5].tolist() for i in range(60))
    assert scored < 0.5 * exact.size
