import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import kernels as K
from rasterloom.operators import axisnotch as X
from rasterloom.operators import composites as C
from rasterloom.operators import destitch as D
from rasterloom.operators import halo as H

rng = np.random.default_rng(2)


def tiles_of(spark, arrays, tile):
    rows = []
    for k, a in arrays.items():
        h, w = a.shape
        for ty in range((h - 1) // tile + 1):
            for tx in range((w - 1) // tile + 1):
                b = a[ty * tile:(ty + 1) * tile, tx * tile:(tx + 1) * tile]
                rows.append((k, ty, tx, ty * tile, tx * tile, b.shape[0], b.shape[1], h, w, b.ravel().tolist()))
    return spark.createDataFrame(rows, "image_id string, ty int, tx int, y0 int, x0 int, h int, w int, fh int, fw int, data array<double>")


def frame(tiles, column, name="a"):
    rows = tiles.filter(tiles.image_id == name).collect()
    out = np.full((rows[0].fh, rows[0].fw), np.nan)
    for r in rows:
        out[r.y0:r.y0 + r.h, r.x0:r.x0 + r.w] = np.array(r[column]).reshape(r.h, r.w)
    return out


def blur(a, sigma, mode):
    t, w = K.gaussian_taps(sigma)
    p = np.pad(a, len(t) // 2, mode="symmetric" if mode == "reflect" else "edge")
    p = np.apply_along_axis(lambda v: np.convolve(v, w[::-1], "valid"), 0, p)
    return np.apply_along_axis(lambda v: np.convolve(v, w[::-1], "valid"), 1, p)


@pytest.mark.parametrize("mode", ["reflect", "nearest"])
def test_tiled_blur_equals_whole_blur(spark, mode):
    a, s = rng.random((37, 29)), 2.0
    got = H.apply_bands(tiles_of(spark, {"a": a, "b": a[:5, :5]}, 8), 8, {"g": lambda w: w.gauss(s, mode=mode)}, 8)
    assert np.allclose(frame(got, "g"), blur(a, s, mode))
    assert np.allclose(frame(got, "g", "b"), blur(a[:5, :5], s, mode))


def test_feature_stack_does_not_depend_on_tiling(spark):
    a = rng.random((40, 33))
    small, whole = (H.feature_stack(tiles_of(spark, {"a": a}, t), t) for t in (16, 64))
    for name in H.FEATURE_NAMES:
        assert np.allclose(frame(small, name), frame(whole, name), atol=1e-9), name
    assert len(H.FEATURE_NAMES) == 17


def test_frame_statistics_do_not_depend_on_tiling(spark):
    from rasterloom.plans import raster as A

    a = rng.random((16, 16)) * np.linspace(0.2, 2, 16)[:, None]
    small, whole = (A.flatfield_tiles(tiles_of(spark, {"a": a}, t), 1, 2, t) for t in (8, 16))
    assert np.allclose(frame(small, "flat"), frame(whole, "flat"), atol=1e-12)
    small, whole = ({(r.y, r.x): r.v8 for r in A.background_free(tiles_of(spark, {"a": a}, t), 3, t).collect()} for t in (8, 16))
    assert small == whole and len(small) == 256


def test_ridge_scale_is_per_frame(spark):
    a = rng.random((30, 30))
    small, whole = (C.ridge_response(tiles_of(spark, {"a": a}, t), t, range(1, 3)) for t in (10, 64))
    assert np.allclose(frame(small, "ridge"), frame(whole, "ridge"), atol=1e-9)


def test_sparse_notch_equals_full_transform(spark):
    h, w, per = 60, 48, 10
    a = 1.0 + 0.3 * np.cos(2 * np.pi * np.arange(h) / per)[:, None] + 0.05 * rng.random((h, w))
    opts = {"min_period": 6, "base_win": 25, "pad_min": 10}
    fixed, report = D.periodic_notch(tiles_of(spark, {"a": a}, 32), **opts)
    r = report.first()
    assert r.applied and r.row_p == pytest.approx(per, rel=0.03)
    o = {**D.DEFAULTS, **opts}
    ph, pw = (max(10, round(o["pad_frac"] * n)) for n in (h, w))
    full = np.fft.fft2(np.pad(a, ((ph, ph), (pw, pw)), mode="reflect"))
    hp, wp = full.shape
    fr, fc = np.fft.fftfreq(hp)[:, None], np.fft.fftfreq(wp)[None, :]
    spread = [o["macro_k"] * p if p else n / 6 for p, n in ((r.row_p, h), (r.col_p, w))]
    low = np.exp(-2 * np.pi ** 2 * ((fr * spread[0]) ** 2 + (fc * spread[1]) ** 2))
    keep = np.ones(full.shape)
    points = [(s * k / r.row_p, 0) for k in [1, *(r.row_h or [])] for s in (1, -1)] + [tuple(c) for c in r.checkers or []]
    points += [(0, s * k / r.col_p) for k in [1, *(r.col_h or [])] for s in (1, -1)] if r.col_p else []
    for tr, tc in points:
        keep *= 1 - np.exp(-0.5 * (((fr - tr) * hp / o["sigma_bins"]) ** 2 + ((fc - tc) * wp / o["sigma_bins"]) ** 2))
    keep[0, 0] = 1
    inner = (slice(ph, ph + h), slice(pw, pw + w))
    want = np.real(np.fft.ifft2(full * (low + (1 - low) * keep)))[inner]
    macro = np.real(np.fft.ifft2(full * low))[inner]
    want = np.clip(np.where(a < np.maximum(o["blank_frac"] * macro, 1e-6), a, want), a.min(), a.max())
    got = frame(fixed, "data")
    assert np.abs(got - want).max() < 1e-9
    assert np.ptp(np.median(got, axis=1)) < 0.6 * np.ptp(np.median(a, axis=1))


def test_frames_without_banding_are_left_alone(spark):
    a = rng.random((40, 40))
    fixed, log = D.repeat_passes(tiles_of(spark, {"a": a}, 64), max_passes=1, tile=64, min_period=6, base_win=25, pad_min=10, win_min=3, win_max=9, edge_margin=3)
    assert frame(fixed, "data").shape == a.shape and log.count() == 1


def test_axis_peaks_go_whole(spark):
    h, w = 48, 60
    y, x = np.mgrid[:h, :w]
    a = 2 + 0.5 * np.cos(2 * np.pi * 8 * y / h) + 0.3 * np.cos(2 * np.pi * 15 * x / w) + 0.01 * rng.random((h, w))
    fixed, stats = X.axis_peak_notch(tiles_of(spark, {"a": a}, 20), band=2, peak_k=30.0, dc=3)
    z = np.fft.fft2(a)
    for row in (8, h - 8):
        for d in (-1, 0, 1):
            z[row + d, [-2, -1, 0, 1, 2]] = 0
    for col in (15, w - 15):
        for d in (-1, 0, 1):
            z[[-2, -1, 0, 1, 2], col + d] = 0
    r = stats.first()
    assert (r.peaks_x, r.peaks_y, r.n_notched) == (2, 2, 12)
    assert np.abs(frame(fixed, "data") - np.real(np.fft.ifft2(z))).max() < 1e-9


def test_line_terms_follow_the_tile_not_the_frame():
    from rasterloom.functions import fourier as W

    for size, pad in ((7, 3), (5, 11), (2, 5), (1, 2)):
        line = rng.random(size)
        turn = np.mod(np.arange(-pad, size + pad), max(2 * (size - 1), 1))
        want = np.fft.fft(line[np.where(turn < size, turn, 2 * (size - 1) - turn)])
        bins = tuple(range(size + 2 * pad))
        got = sum(W.line_terms(size, pad, bins, at, min(3, size - at)) @ line[at:at + 3] for at in range(0, size, 3))
        assert np.allclose(got, want, atol=1e-10)
        assert W.line_terms(10 ** 9, 10 ** 8, (0, 1), 5, 3).shape == (2, 3)


@pytest.mark.parametrize("strip", [1, 100])
def test_low_pass_by_strips(spark, monkeypatch, strip):
    monkeypatch.setattr(D, "STRIP", strip)
    a = rng.random((21, 17))
    periods = spark.createDataFrame([("a", 6, 5, 0.03, 0.05)], "image_id string, ph int, pw int, cut_r double, cut_c double")
    full = np.fft.fft2(np.pad(a, ((6, 6), (5, 5)), mode="reflect"))
    fr, fc = np.fft.fftfreq(33)[:, None] / 0.03, np.fft.fftfreq(27)[None, :] / 0.05
    want = np.real(np.fft.ifft2(full * np.exp(-0.5 * (fr ** 2 + fc ** 2))))[6:27, 5:22]
    got = np.full(a.shape, np.nan)
    for r in D.macro_pieces(tiles_of(spark, {"a": a}, 8), periods).collect():
        for p in r.pieces:
            got[p.y0:p.y0 + p.h, p.x0:p.x0 + p.w] = np.reshape(p.data, (p.h, p.w))
    assert np.abs(got - want).max() < 1e-12


@pytest.mark.parametrize("n", [1, 2, 5, 40, 700])
def test_running_median_mirrors_the_line(n):
    for half in (4, 5):
        v = np.round(rng.random(n), 1)
        mirrored = {**{f: v[f] for f in range(n)}, **{-1 - f: v[f] for f in range(n)}, **{2 * n - 1 - f: v[f] for f in range(n)}}
        want = [np.median([mirrored[p] for p in range(f - half, f + half + 1) if p in mirrored and -half <= p < n + half]) for f in range(n)]
        assert np.allclose(X.running_median(v, half), want, atol=1e-15)


def test_a_worker_holds_a_bounded_part_of_a_batch(spark):
    from rasterloom.operators import lookup as E
    from rasterloom.session import PART_CELLS, in_parts

    tiles = spark.range(3000).select(F.col("id").cast("string").alias("image_id"), *[F.lit(n).alias(c) for c, n in zip(H.GEOMETRY[1:], (0, 0, 0, 0, 8, 8, 8, 8))],
                                     F.array_repeat(F.col("id").cast("double"), 64).alias("data")).coalesce(1)

    def size(win):
        return np.full_like(win.centre(), len(win.data))

    out = H.apply_bands(tiles, 256, {"n": size}, 8).select("image_id", "data", F.get("n", F.lit(0)).alias("n")).toPandas()
    assert len(out) == 3000 and (out["data"].map(lambda a: a[5]) == out["image_id"].astype(float)).all()
    assert out["n"].max() <= PART_CELLS / (2 * 256 * 8) + 1
    cut = list(in_parts([pd.DataFrame({"k": range(7)})], lambda p: [1, PART_CELLS, 1, 1, 5 * PART_CELLS, 1, 1]))
    assert [k for c in cut for k in c["k"]] == list(range(7)) and len(cut) == 3 and list(in_parts([cut[0][:0]], lambda p: p["k"])) == []
    one = [{"image_id": i, "tile_ord": 0, "y0": 0, "x0": 0, "c": 1, "gy": 2, "gx": 2, "e": [float(i)] * 4} for i in range(5)]
    at = spark.createDataFrame([(i, y, 0) for i in range(5) for y in range(3)], "image_id int, y int, x int")
    got = E.bilinear_lookup(at, spark.createDataFrame(one, "image_id int, tile_ord int, y0 int, x0 int, c int, gy int, gx int, e array<double>"), 4, 2.0).collect()
    assert len(got) == 15 and all(r.vec == [float(r.image_id)] for r in got)
