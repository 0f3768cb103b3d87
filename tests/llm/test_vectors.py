"""Vector operators against brute force: hard vectors, copies, ties, and blocks of every size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import ann, lattice
from rasterloom.llm.common import prepare

SCHEMA = "vec_id bigint, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x[:1] + 0.02 * rng.normal(size=(60, 24))  # a group of near copies
    pair = np.repeat(x[10:30], 2, axis=0) + 0.03 * rng.normal(size=(40, 24))
    same = np.repeat(x[40:41] * 2.5, 30, axis=0)  # copies of another length
    data = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(np.concatenate([x, near, pair, same]))]
    bad = [(1000, None, 1), (1001, [0.0] * 24, 1), (1020, [float("nan")] + [1.0] * 23, 1), (1040, [float("inf")] + [1.0] * 23, None), (1060, [None] + [1.0] * 23, 1),
           (None, [1.0] * 24, 1), (1080, [], 1), (1100, [1.0, 2.0, 3.0], 1), (1101, [1.0, 2.0, 3.1], 1), (1102, [-1.0, 0.0, 0.5], 1)]
    return data + bad


@pytest.fixture(scope="module")
def vectors(spark, rows):
    prepare(spark)
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("score", "rank", "dim", "e", "cell", "weight", "kept")}).repartition(3)


def fine(rows):
    return [(i, np.array(e, np.float32).astype(float)) for i, e, _ in rows if i is not None and e and None not in e and np.isfinite(np.array(e, float)).all() and any(e)]


@pytest.mark.parametrize("block", [4096, 16])
def test_links_and_components(spark, vectors, rows, block, monkeypatch):
    monkeypatch.setattr(lattice, "VECTOR_ROWS", block)
    good = fine(rows)
    links, root = {i: set() for i, *_ in rows if i is not None}, {i: i for i, *_ in rows if i is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in good:
        for j, b in good:
            if i < j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                links[i].add(j)
                links[j].add(i)
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    got = lattice.near_copies(vectors).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"]) == (0, None)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (len(links[r["vec_id"]]), find(r["vec_id"]), find(r["vec_id"]) == r["vec_id"]), r
    assert max(len(v) for v in links.values()) >= 60


def test_no_vectors(spark, vectors):
    assert lattice.near_copies(vectors.limit(0)).count() == 0 and ann.search(vectors.limit(0)).count() == 0


def test_lattice_decodes_to_the_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 2, (300, 8))
    point = lattice.decode(x)
    assert ((np.rint(point.sum(1)).astype(int) % 2) == 0).all() and (np.ptp(point % 1, axis=1) == 0).all()
    best = ((x - point) ** 2).sum(1)
    assert len(lattice.ROOTS) == 240 and np.allclose((lattice.ROOTS ** 2).sum(1), 2)
    for r in lattice.ROOTS:
        assert (best <= ((x - point - r) ** 2).sum(1) + 1e-9).all()


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    g = rng.normal(size=a.shape)
    g -= (g * a).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95 ** 2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    ka, kb = (lattice.cell_keys(v, lattice.TABLES, lattice.PROBES) for v in (a, b))
    assert ((kb == ka[:, :, :1]).any(2) | (ka == kb[:, :, :1]).any(2)).any(1).mean() > 0.998
    assert np.array_equal(lattice.cell_keys(a[17:18], 4, 8)[0], lattice.cell_keys(a, 4, 8)[17])


@pytest.mark.parametrize("block", [4096, 16])
def test_search(spark, vectors, rows, block, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_ROWS", block)
    got = {}
    for r in ann.search(vectors).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = fine(rows)
    hit = total = 0
    assert set(got) == {i for i, _ in good if i % 20 == 0}
    for i, a in good:
        if i % 20:
            continue
        all_of = sorted(((-(a * b).sum(), j) for j, b in good if j != i and len(a) == len(b)))
        mine = sorted(got[i])
        assert [m[0] for m in mine] == list(range(1, min(20, len(all_of)) + 1))
        score = {j: -s for s, j in all_of}
        assert [(-s, j) for _, j, s in mine] == sorted((-s, j) for _, j, s in mine)
        assert all(s == pytest.approx(score[j], abs=1e-12) for _, j, s in mine)
        hit += len({j for _, j, _ in mine} & {j for _, j in all_of[:20]})
        total += min(20, len(all_of))
    assert hit / total >= 0.9


def test_search_returns_all_candidates_of_a_small_table(spark):
    rng = np.random.default_rng(0)
    few = spark.createDataFrame([(i, rng.normal(size=16).tolist(), 1) for i in range(12)] + [(20, [1.0] * 16, 1)] * 2, SCHEMA)
    got = ann.search(few).collect()
    assert sorted(r["vec_id"] for r in got if r["query_id"] == 0) == [*range(1, 12), 20]
    assert sorted(r["vec_id"] for r in got if r["query_id"] == 20) == list(range(12))


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(50, 32))
    assert np.allclose((ann.turned(x, 3) ** 2).sum(1), (x ** 2).sum(1))


@pytest.mark.parametrize("norms", ["one long row", "log-normal"])
def test_search_on_uneven_norms(spark, norms):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "one long row":
        x[1] *= 10
    else:
        x *= rng.lognormal(0, 1, (len(x), 1))
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert len(got[q]) == 20
        recall.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9 and min(recall) >= 0.5


def test_norms_beyond_squares(spark):
    """Vectors whose squares overflow or vanish are as near as any other."""
    rng = np.random.default_rng(7)
    prepare(spark)
    scale = [1e200, 1.1e200, 1e-200, 2e-200, 1.0, 1e308, 5e-320]
    rows = [(i, [s] * 16, 1) for i, s in enumerate(scale)] + [(i, rng.normal(size=16).tolist(), 1) for i in range(20, 60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_copies(df).collect()}
    assert all(got[i] == (len(scale) - 1, 0) for i in range(len(scale))) and all(got[i] == (0, i) for i in range(20, 60))
    found = {}
    for r in sorted(ann.search(df).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
    x = {i: np.array(e) for i, e, _ in rows}
    for q in (0, 20, 40):
        with np.errstate(over="ignore", invalid="ignore"):
            score = {j: float((v * x[q]).sum()) for j, v in x.items() if j != q}
        best = sorted((-s, j) for j, s in score.items() if s == s)[:20]
        assert len(found[q]) == 20 and len(set(found[q]) & {j for _, j in best}) >= 18
