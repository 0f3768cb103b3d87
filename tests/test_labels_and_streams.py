import datetime as dt
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rasterloom.operators import labels as L
from rasterloom.operators import sampling as K
from rasterloom.sources import frames as R
from rasterloom.sources import sinks
from rasterloom.streaming import strokes as W

SCHEMA = "image_id long, y int, x int, state int"


def test_packing_round_trip(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(y), int(x), int(rng.integers(1, 3))) for i in range(3) for y, x in np.argwhere(rng.random((6, 9)) < 0.6)]
    df = spark.createDataFrame(rows, SCHEMA)
    runs = L.pack_runs(df)
    assert runs.count() < df.count()
    assert {tuple(r) for r in L.unpack_runs(runs).select("image_id", "y", "x", "state").collect()} == set(rows)


def test_live_frames_win_and_absent_ones_are_carried(spark):
    live = spark.createDataFrame([(1, 0, 0, 1)], SCHEMA)
    arch = spark.createDataFrame([(1, 0, 1, 2), (2, 0, 0, 2)], SCHEMA)
    got = {(r.image_id, r.x, r.origin) for r in L.merge_snapshot(live, arch).collect()}
    assert got == {(1, 0, "live"), (2, 0, "carried")}
    assert L.merge_snapshot(live, arch, prune=True).count() == 1


def test_conflicts_are_dropped_not_flipped(spark):
    lab = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 2), (1, 0, 2, 2)], SCHEMA)
    truth = spark.createDataFrame([(1, 0, 0, False), (1, 0, 1, True)], "image_id long, y int, x int, is_pos boolean")
    assert {r.x for r in L.clear_conflicts(lab, truth).collect()} == {0, 2}
    assert {r.x for r in L.clear_conflicts(lab, truth, both_sides=True).collect()} == {2}


def test_tiles_sit_on_the_specimen_and_do_not_overlap(spark):
    frames = spark.createDataFrame([("a", 40, 40), ("tiny", 3, 3)], "image_id string, height int, width int")
    px = spark.createDataFrame([("a", y, x) for y in range(40) for x in range(25)], "image_id string, y int, x int")
    t = K.sample_tiles(frames, px, want=5, tile=8, seed=1).toPandas()
    assert set(t.image_id) == {"a"} and 0 < len(t) <= 5
    for i, a in t.iterrows():
        assert max(0, min(a.x + 8, 25) - a.x) >= 0.9 * 8
        for j, b in t.iterrows():
            assert i == j or abs(a.y - b.y) >= 4 or abs(a.x - b.x) >= 4


def stroke_rows(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, im, t0 + dt.timedelta(seconds=i), mode, y, x, r) for i, (im, mode, y, x, r) in enumerate(rows)],
                                 "stroke_id long, image_id long, ts timestamp_ntz, mode string, y int, x int, radius int")


def test_stream_replays_like_the_batch_and_can_undo(spark, tmp_path):
    rows = [(1, "crack", 2, 2, 1), (1, "erase", 2, 3, 1), (2, "crack", 5, 5, 2), (1, "clear", 0, 0, 1), (1, "crack", 8, 8, 1), (2, "erase", 5, 5, 1)]
    batch = stroke_rows(spark, rows)
    want = {tuple(r) for r in W.stroke_labels(batch, 10, 10).select("image_id", "y", "x", "state").collect()}

    def drain(df, name, batch):
        out = W.in_turn(df, batch, name, lambda stream, base: W.run_to_table(W.stroke_stream(stream, 10, 10, tile=4), W.CHANGES, "update", base))
        return {tuple(r) for r in W.latest_labels(out).select("image_id", "y", "x", "state").collect()}

    assert drain(batch, "plain", F.lit(0)) == want
    assert drain(batch, "late", -F.col("stroke_id")) == want  # newest first, one by one
    undone = stroke_rows(spark, rows + [(2, "undo", 0, 0, 1)])
    assert drain(undone, "undo", F.col("stroke_id")) == {tuple(r) for r in W.stroke_labels(stroke_rows(spark, rows[:-1]), 10, 10).select("image_id", "y", "x", "state").collect()}


def test_small_tiles_of_neighbouring_frames_share_a_state_row(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(-70, 200)), str(rng.choice(["crack", "erase", "clear"], p=[0.5, 0.4, 0.1])), int(rng.integers(10)), int(rng.integers(10)), 1) for _ in range(900)]
    df = stroke_rows(spark, rows)
    want = {tuple(r) for r in W.stroke_labels(df, 10, 10).select("image_id", "y", "x", "state").collect()}
    bases = []

    def drain(stream, base):
        bases.append(base)
        return W.run_to_table(W.stroke_stream(stream, 10, 10, tile=8), W.CHANGES, "update", base)

    out = W.in_turn(df, F.pmod("stroke_id", F.lit(3)), "shared", drain)
    assert {tuple(r) for r in W.latest_labels(out).select("image_id", "y", "x", "state").collect()} == want
    states = spark.read.format("statestore").load(f"{bases[0]}/state").count()
    assert states <= 4 * 6  # four tiles, frames in groups of 64; one row a tile and frame would be about 1000


def test_settled_and_live_strokes_replay_alike():
    rng = np.random.default_rng(3)
    events = [(t, t, rng.choice(["crack", "erase", "clear"], p=[0.5, 0.45, 0.05]), int(rng.integers(8)), int(rng.integers(8)), int(rng.integers(1, 4))) for t in range(120)]
    want = np.zeros((8, 8), int)
    for _, _, mode, y, x, r in events:
        hit = (np.arange(8) - y)[:, None] ** 2 + (np.arange(8) - x)[None, :] ** 2 <= r * r
        want = np.zeros((8, 8), int) if mode == "clear" else np.where(hit, 1 if mode == "crack" else 2, want)
    for order in (events, rng.permutation(np.array(events, dtype=object)).tolist()):
        held = W.TileLabels(8, 8, 0, 0)
        for e in order:
            held.add(tuple(e))
            held = W.TileLabels(8, 8, 0, 0, held.saved())
        assert (held.raster() == want).all() and len(held.live) == W.UNDO_DEPTH


def test_undo_takes_back_the_newest_stroke_before_it():
    held = W.TileLabels(5, 5, 0, 0)
    for e in [(1, 1, "crack", 1, 1, 1), (2, 2, "erase", 3, 3, 1), (5, 5, "crack", 0, 4, 1), (3, 3, "undo", 0, 0, 1)]:
        held.add(e)
    assert [s[0] for s in held.live] == [1, 5] and held.raster()[3, 3] == 0
    for k in range(40):
        held.add((10 + k, 10 + k, "undo", 0, 0, 1))
    assert not held.live and not held.raster().any()



def png(path, a):
    """Minimal 8-bit RGB file."""
    def chunk(tag, body):
        return len(body).to_bytes(4, "big") + tag + body + zlib.crc32(tag + body).to_bytes(4, "big")

    h, w, _ = a.shape
    raw = b"".join(b"\0" + a[y].astype(np.uint8).tobytes() for y in range(h))
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files_and_scan(spark, tmp_path):
    (tmp_path / "grp").mkdir()
    a = np.arange(2 * 3 * 3).reshape(2, 3, 3) * 10
    png(tmp_path / "grp" / "one.png", a)
    (tmp_path / "grp" / "one_mask.png").write_bytes(b"x")
    (tmp_path / "note.txt").write_bytes(b"x")
    found = R.scan_frames(spark, str(tmp_path), exclude=("_mask",)).collect()
    assert [(r.name, r.grp) for r in found] == [("one", "grp")]
    px = R.collapse_planes(R.read_images(spark, found[0].path)).toPandas()
    got = px.pivot(index="y", columns="x", values="v").to_numpy()
    assert np.allclose(got, a.mean(axis=2))


def test_sinks_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 9), ("a", 2, 30), ("b", 3, 7)], "image_id string, region_id long, area long")
    sinks.write_regions_csv(df, str(tmp_path / "csv"))
    back = spark.read.schema("region_id long, area long, image_id string").option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 3 and back.agg(F.sum("area")).first()[0] == 46
    sinks.write_summary(df, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    runs = spark.createDataFrame([(1, 0, 0, 4, 1)], "image_id long, y int, x0 int, x1 int, state int")
    sinks.write_label_archive(runs, str(tmp_path / "arch"))
    assert L.unpack_runs(spark.read.parquet(str(tmp_path / "arch"))).count() == 5
    probs = spark.createDataFrame([("a", "m1", 0, 0, 0.5)], "image_id string, model_key string, y int, x int, p double")
    sinks.write_predictions(probs, str(tmp_path / "probs"))
    assert spark.read.parquet(str(tmp_path / "probs")).filter("model_key = 'm1'").count() == 1
