import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import components, dilate, erode, mask_frame, to_array
from rasterloom.operators import components as C
from rasterloom.operators import fragments as M
from rasterloom.operators import regions as G
from rasterloom.operators import runs as R
from rasterloom.operators import shapes as H
from rasterloom.session import materialize

rng = np.random.default_rng(5)
A, B = rng.random((17, 23)) < 0.45, rng.random((17, 23)) < 0.6


def runs_of(spark, m, name="a"):
    return R.from_pixels(mask_frame(spark, {name: m}))


def offsets(shape):
    return [(dy, dx) for dy, hw in shape for dx in range(-hw, hw + 1)]


def test_set_algebra(spark):
    a, b = runs_of(spark, A), runs_of(spark, B)
    frames = spark.createDataFrame([("a", 17, 23)], "image_id string, fh int, fw int")
    assert (to_array(R.union(a, b), A.shape) == (A | B)).all()
    assert (to_array(R.intersect(a, b), A.shape) == (A & B)).all()
    assert (to_array(R.subtract(a, b), A.shape) == (A & ~B)).all()
    assert (to_array(R.complement(a, frames), A.shape) == ~A).all()
    n = lambda r: r.agg(F.sum(G.run_length())).first()[0]
    assert n(R.union(a, b)) == n(a) + n(b) - n(R.intersect(a, b))


@pytest.mark.parametrize("shape", [R.disk(2), R.box(1), R.cross(1)])
def test_morphology(spark, shape):
    m, offs = B, offsets(shape)
    r = runs_of(spark, m)
    assert (to_array(R.dilate(r, shape), m.shape) == dilate(m, offs)).all()
    for outside in (False, True):
        assert (to_array(R.erode(r, shape, outside), m.shape) == erode(m, offs, outside)).all()
        assert (to_array(R.closing(r, shape, outside), m.shape) == erode(dilate(m, offs), offs, outside)).all()


@pytest.mark.parametrize("conn", [4, 8])
@pytest.mark.parametrize("tile", [1024, 4])
def test_components_on_seams(spark, conn, tile):
    masks = {"a": A, "b": B, "full": np.ones((9, 9), bool), "diag": np.eye(9, dtype=bool)}
    lab = C.label_runs(R.from_pixels(mask_frame(spark, masks)), conn, tile)
    got = R.to_pixels(lab, "region_id").toPandas()
    for name, m in masks.items():
        want, part = components(m, conn), got[got.image_id == name]
        assert len(part) == m.sum()
        for label, g in part.groupby(want[part.y, part.x]):
            first = g.sort_values(["y", "x"]).iloc[0]
            assert (g.region_id == int(first.y) * (1 << 31) + int(first.x)).all()


def test_wide_frames_keep_regions_apart(spark):
    far = 1 << 20
    px = spark.createDataFrame([("a", 2, 3 * far, 0, far), ("a", 2, 3 * far, 1, 0), ("a", 2, 3 * far, 1, 2 * far + 5), ("a", 2, 3 * far, 0, 2 * far + 4)],
                               "image_id string, fh int, fw int, y int, x int")
    lab = R.to_pixels(C.label_runs(R.from_pixels(px), 8), "region_id").toPandas()
    assert lab.region_id.nunique() == 3 and (lab.groupby("region_id").size().sort_values() == [1, 1, 2]).all()


def test_connectivity_must_be_named(spark):
    with pytest.raises(ValueError):
        C.label_runs(runs_of(spark, A), 6)


def test_empty_mask(spark):
    r = runs_of(spark, A).filter("false")
    assert C.label_runs(r, 8).count() == 0 and G.remove_small(r, 3, 4).count() == 0


def test_prune_keeps_the_minimum_area(spark):
    m = np.zeros((5, 12), bool)
    m[1, 0:4], m[3, 0:3], m[0, 8], m[1, 9] = True, True, True, True
    assert to_array(G.remove_small(runs_of(spark, m), 4, 4), m.shape).sum() == 4
    assert to_array(G.remove_small(runs_of(spark, m), 2, 8), m.shape).sum() == 9
    assert to_array(G.remove_small(runs_of(spark, m), 2, 4), m.shape).sum() == 7


def test_holes_and_euler(spark):
    ring = np.zeros((8, 8), bool)
    ring[1:5, 1:5] = True
    ring[2:4, 2:4] = False
    leak = ring.copy()
    leak[1, 1] = False
    lab = C.label_runs(R.from_pixels(mask_frame(spark, {"a": ring, "b": np.ones((3, 3), bool)})), 8)
    assert {r.image_id: r.euler for r in G.euler_numbers(lab).collect()} == {"a": 0, "b": 1}
    assert to_array(G.fill_holes(runs_of(spark, ring)), ring.shape).sum() == 16
    assert to_array(G.fill_holes(runs_of(spark, ring), max_area=3), ring.shape).sum() == 12
    assert to_array(G.fill_holes(runs_of(spark, leak), tile=3), leak.shape).sum() == 15


def test_props_of_simple_shapes(spark):
    m = np.zeros((6, 20), bool)
    m[2, 3:13] = True
    p = G.region_props(C.label_runs(runs_of(spark, m), 8)).first()
    assert (p.area, p.y0, p.y1, p.x0, p.x1, p.cy, p.cx) == (10, 2, 3, 3, 13, 2.0, 7.5)
    assert p.minor == 0 and p.ecc == 1 and p.major == pytest.approx(4 * np.sqrt(np.var(np.arange(10))))


@pytest.mark.parametrize("tile,halo", [(64, 16), (8, 6)])
def test_skeleton_does_not_depend_on_tiling(spark, tile, halo):
    m = np.zeros((40, 60), bool)
    m[10:20, 5:50], m[5:35, 30:36] = True, True
    lab = C.label_runs(runs_of(spark, m), 8)
    got = H.skeleton(lab, tile=tile, halo=halo).toPandas()
    want, _ = H.thin(m, 100)
    out = np.zeros_like(m)
    out[got.y, got.x] = True
    assert (out == want).all()
    width = H.max_widths(lab, H.skeleton(lab, tile=tile, halo=halo), tile, halo).first().max_width
    bg = np.argwhere(~m)
    best = max(np.sqrt(((bg - p) ** 2).sum(1).min()) for p in np.argwhere(want))
    assert width == pytest.approx(2 * best)


def test_hull_of_an_l_shape(spark):
    m = np.zeros((10, 10), bool)
    m[1:9, 1:3], m[7:9, 1:9] = True, True
    h = H.hull_measures(C.label_runs(runs_of(spark, m), 8)).first()
    assert m.sum() < h.hull_area < 64


def test_spanning_tree(spark):
    e = spark.createDataFrame([("a", 1, 2, 1.0), ("a", 2, 3, 2.0), ("a", 1, 3, 3.0), ("a", 7, 8, 1.0), ("b", 1, 2, 5.0)], "image_id string, u long, v long, gap double")
    assert {(r.image_id, r.u, r.v) for r in M.spanning_tree(e).collect()} == {("a", 1, 2), ("a", 2, 3), ("a", 7, 8), ("b", 1, 2)}


def dijkstra(cost, start):
    import heapq

    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, (y, x) = heapq.heappop(heap)
        if d > best[(y, x)]:
            continue
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                q = (y + dy, x + dx)
                if (dy or dx) and 0 <= q[0] < cost.shape[0] and 0 <= q[1] < cost.shape[1]:
                    n = d + (cost[y, x] + cost[q]) / 2 * (2 ** 0.5 if dy and dx else 1)
                    if n < best.get(q, np.inf):
                        best[q] = n
                        heapq.heappush(heap, (n, q))
    return best


def test_routes_cost_what_a_heap_finds():
    wall = np.ones((9, 12))
    wall[0:8, 2], wall[1:9, 5] = 100, 100
    stack = [wall, rng.random((9, 12)), np.zeros((9, 12)), np.where(rng.random((9, 12)) < 0.5, 0.0, 5.0)]
    cost = np.full((5, 9, 12), np.inf)
    cost[:4], cost[4, :4, :3] = stack, rng.random((4, 3))
    starts, ends = np.array([[0, 0], [8, 11], [4, 4], [0, 0], [0, 0]]), np.array([[0, 11], [0, 0], [4, 9], [8, 8], [3, 2]])
    for k, path in enumerate(M.routes(cost, starts, ends.copy())):
        shape = (9, 12) if k < 4 else (4, 3)
        best = dijkstra(cost[k, :shape[0], :shape[1]], tuple(starts[k]))
        assert path[0] == tuple(ends[k]) and path[-1] == tuple(starts[k])
        total = 0.0
        for p, q in zip(path, path[1:]):
            assert max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1
            total += (cost[k][p] + cost[k][q]) / 2 * np.hypot(p[0] - q[0], p[1] - q[1])
        assert total == pytest.approx(best[tuple(ends[k])], abs=1e-3)


@pytest.mark.parametrize("tile", [512, 8])
def test_near_pairs(spark, tile):
    masks = {"a": rng.random((40, 50)) < 0.12, "b": rng.random((30, 20)) < 0.3}
    lab = C.label_runs(R.from_pixels(mask_frame(spark, masks)), 8)
    px = R.to_pixels(lab, "region_id").toPandas()
    want = {}
    for name, g in px.groupby("image_id"):
        p = g[["region_id", "y", "x"]].to_numpy()
        d2 = ((p[:, None, 1:] - p[None, :, 1:]) ** 2).sum(2)
        for i, j in np.argwhere(d2 <= 16):
            if p[i, 0] < p[j, 0]:
                key, val = (name, p[i, 0], p[j, 0]), (d2[i, j], *p[i, 1:], *p[j, 1:])
                want[key] = min(want.get(key, val), val)
    got = {(r.image_id, r.u, r.v): (round(r.gap ** 2), r.ay, r.ax, r.by, r.bx) for r in M.near_pairs(lab, 4, tile).collect()}
    assert got == want and len(got) > 50


@pytest.mark.parametrize("tile", [512, 16])
def test_groups_hold_their_first_region(spark, tile, monkeypatch):
    monkeypatch.setattr(M, "NEAR_TILE", tile)
    m = np.zeros((12, 40), bool)
    m[2:4, 1:8], m[2:4, 10:18], m[3:5, 20:28], m[8:10, 32:39] = True, True, True, True
    px = spark.createDataFrame([("a", 12, 40, y, x, 0.0) for y in range(12) for x in range(40)], "image_id string, fh int, fw int, y int, x int, v double")
    groups, bridges = M.merge_fragments(C.label_runs(runs_of(spark, m), 8), px, min_area=8, max_gap=4, max_bridge=1, margin=3)
    first = [2 * (1 << 31) + 1, 2 * (1 << 31) + 10, 3 * (1 << 31) + 20]
    assert sorted((r.region_id, r.group_id) for r in groups.collect()) == [(f, first[0]) for f in first]
    assert bridges.count() == 2


@pytest.mark.parametrize("tile", [512, 5])
def test_flood_against_a_fill(spark, tile):
    from rasterloom.operators import clicks as K

    v = np.cumsum(rng.normal(size=(23, 31)), axis=1) / 3
    px = spark.createDataFrame([("a", 23, 31, y, x, float(v[y, x])) for y in range(23) for x in range(31)] + [("b", 2, 2, 0, 0, 1.0), ("b", 2, 2, 1, 1, 1.4)],
                               "image_id string, fh int, fw int, y int, x int, v double")
    seeds = [(f"a{i}", "a", int(y), int(x)) for i, (y, x) in enumerate(zip(rng.integers(0, 23, 12), rng.integers(0, 31, 12)))] + [("b0", "b", 0, 0), ("none", "b", 0, 1)]
    tol = spark.createDataFrame([("a", 0.8), ("b", 0.5)], "image_id string, tol double")
    for conn in (4, 8):
        got = K.flood(spark.createDataFrame(seeds, "click_id string, image_id string, y int, x int"), px, tol, connectivity=conn, tile=tile)
        for click, image, y, x in seeds[:12]:
            lab = components(np.abs(v - v[y, x]) <= 0.8, conn)
            assert (to_array(got, v.shape, click) == (lab == lab[y, x])).all()
        assert to_array(got, (2, 2), "b0").sum() == (2 if conn == 8 else 1) and got.filter("image_id = 'none'").count() == 0


def test_edge_pixels_and_perimeter(spark):
    lab = C.label_runs(runs_of(spark, B), 8)
    got = {(r.y, r.x): r.region_id for r in G.border_pixels(lab).collect()}
    pad = np.pad(B, 1)
    inner = pad[:-2, 1:-1] & pad[2:, 1:-1] & pad[1:-1, :-2] & pad[1:-1, 2:]
    names = {(r.y, r.x): r.region_id for r in R.to_pixels(lab, "region_id").collect()}
    assert got == {tuple(p): names[tuple(p)] for p in np.argwhere(B & ~inner).tolist()}


def test_greedy_union_over_many_sets(spark):
    from rasterloom.operators import proposals as P

    masks = rng.random((27, 8, 9)) < 0.3
    truth = rng.random((8, 9)) < 0.4
    rows = [("a", f"p{k:02d}", int(y), int(x)) for k in range(27) for y, x in np.argwhere(masks[k])]
    t = spark.createDataFrame([("a", int(y), int(x)) for y, x in np.argwhere(truth)], "image_id string, y int, x int")
    got = {r.proposal: r.iou for r in P.greedy_union(spark.createDataFrame(rows, "image_id string, proposal string, y int, x int"), t).collect()}
    iou = lambda m: (m & truth).sum() / max((m | truth).sum(), 1)
    purity = [(masks[k] & truth).sum() / masks[k].sum() for k in range(27)]
    now, best, chosen = np.zeros_like(truth), 0.0, set()
    for k in sorted(range(27), key=lambda k: (-purity[k], k)):
        if iou(now | masks[k]) > best:
            now, best, chosen = now | masks[k], iou(now | masks[k]), chosen | {f"p{k:02d}"}
    major = {k for k in range(27) if purity[k] > 0.5}
    if major and iou(np.any([masks[k] for k in major], axis=0)) > best:
        best, chosen = iou(np.any([masks[k] for k in major], axis=0)), {f"p{k:02d}" for k in major}
    assert set(got) == chosen and all(v == pytest.approx(best) for v in got.values())


def test_painted_pixels_survive_pruning(spark):
    from rasterloom.plans.regions import effective_mask

    frames = spark.createDataFrame([("a", 17, 23)], "image_id string, fh int, fw int")
    labels = spark.createDataFrame([("a", 0, 0, 1), ("a", 16, 22, 1), ("a", 8, 8, 2)], "image_id string, y int, x int, state int")
    got = to_array(effective_mask(runs_of(spark, A), labels, frames, 50), A.shape)
    assert got[0, 0] and got[16, 22] and not got[8, 8]


def test_pixels_of_runs_are_not_broadcast(spark):
    runs = materialize(spark.range(200).selectExpr("'a' AS image_id", "200 AS fh", "30 AS fw", "CAST(id AS INT) AS y", "0 AS x0", "29 AS x1"), "runs")
    px = R.to_pixels(runs)
    joined = px.join(px.selectExpr("image_id", "y", "x", "x * 2 AS v"), ["image_id", "y", "x"])
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 6000


def test_greedy_union_takes_few_rounds_for_many_proposals(spark, monkeypatch):
    from rasterloom.operators import proposals as P

    masks = {f"p{k:03d}": [(k, x) for x in range(1 + k % 9)] + [(k + 1, x) for x in range(k % 4)] for k in range(200)}
    truth = {(k, x) for k in range(201) for x in range(k * 7 % 11)}
    rows = [("a", name, y, x) for name, cells in masks.items() for y, x in cells]
    t = spark.createDataFrame([("a", y, x) for y, x in truth], "image_id string, y int, x int")
    written = []
    monkeypatch.setattr(P, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    got = {r.proposal: r.iou for r in P.greedy_union(spark.createDataFrame(rows, "image_id string, proposal string, y int, x int"), t).collect()}
    now, best, chosen = set(), 0.0, set()
    iou = lambda cells: len(cells & truth) / max(len(cells | truth), 1)
    purity = {name: len(set(cells) & truth) / len(cells) for name, cells in masks.items()}
    for name in sorted(masks, key=lambda name: (-purity[name], name)):
        if iou(now | set(masks[name])) > best:
            now, chosen = now | set(masks[name]), chosen | {name}
            best = iou(now)
    major = {name for name in masks if purity[name] > 0.5}
    if iou({c for name in major for c in masks[name]}) > best:
        best, chosen = iou({c for name in major for c in masks[name]}), major
    assert set(got) == chosen and all(v == pytest.approx(best) for v in got.values())
    assert len(written) < 20  # ten proposals to a round were five tables for each ten


@pytest.mark.parametrize("block", [3, 4096])
def test_hulls_of_many_regions_share_a_call(spark, monkeypatch, block):
    from fractions import Fraction

    monkeypatch.setattr(H, "HULL_BLOCK", block)
    m = np.zeros((40, 37), bool)
    m[:22] = rng.random((22, 37)) < 0.4
    m[24:39, 2:4], m[30:32, 2:30], m[39, 36] = True, True, True
    lab = C.label_runs(runs_of(spark, m), 8)
    hull = H.hull_runs(lab)
    assert "FlatMapGroupsInPandas" not in hull._jdf.queryExecution().executedPlan().toString()  # a call per region
    got = {(r.region_id, r.y): (r.x0, r.x1) for r in hull.collect()}
    ends, want = {}, {}
    for r in R.to_pixels(lab, "region_id").collect():
        a, b = ends.setdefault(r.region_id, {}).get(r.y, (r.x, r.x))
        ends[r.region_id][r.y] = min(a, r.x), max(b, r.x)
    for region, rows in ends.items():
        pts = [(2 * y + d, 2 * a - (d == 0), 2 * b + (d == 0)) for y, (a, b) in rows.items() for d in (-1, 0, 1)]
        for y in rows:
            pairs = [(p, q) for p in pts for q in pts if p[0] <= 2 * y <= q[0]]
            cut = [[p[s] + Fraction((q[s] - p[s]) * (2 * y - p[0]), max(q[0] - p[0], 1)) for p, q in pairs] for s in (1, 2)]
            want[region, y] = -int(-min(cut[0]) // 2), int(max(cut[1]) // 2)
    assert got == want
    area = {r.region_id: r.hull_area for r in H.hull_areas(lab).collect()}
    assert area == {region: sum(want[region, y][1] - want[region, y][0] + 1 for y in rows) for region, rows in ends.items()}


def test_hull_perimeter_from_neighbouring_rows(spark):
    m = rng.random((30, 41)) < 0.35
    m[3:20, 5:24] = True
    lab = C.label_runs(runs_of(spark, m), 8)
    hull = H.hull_runs(lab)
    got = {(r.region_id, r.y, r.x) for r in H.hull_border(hull).collect()}
    cells = {(r.region_id, r.y, x) for r in hull.collect() for x in range(r.x0, r.x1 + 1)}
    assert got == {(k, y, x) for k, y, x in cells if not {(k, y - 1, x), (k, y + 1, x), (k, y, x - 1), (k, y, x + 1)} <= cells}
    own = hull.select(F.concat_ws("#", "image_id", "region_id").alias("image_id"), "region_id", F.lit(30).alias("fh"), F.lit(41).alias("fw"), "y", "x0", "x1")
    want = {r.image_id: r.perimeter for r in G.perimeters(own).collect()}
    measured = H.hull_measures(lab).collect()
    assert {f"{r.image_id}#{r.region_id}": r.hull_perimeter for r in measured} == pytest.approx(want)
