"""TIFF strips and tiles: round trips of every sample type, both byte orders, damaged files, and layouts written by hand."""

import struct

import numpy as np
import pytest

from rasterloom.sources import tiff

SCHEMA = "image_id bigint, content binary"


def frames(rows):
    out = {}
    for r in rows:
        a = out.setdefault(r["image_id"], np.full((r["fh"], r["fw"]), np.nan))
        a[r["y0"]:r["y0"] + r["h"], r["x0"]:r["x0"] + r["w"]] = np.array(r["data"]).reshape(r["h"], r["w"])
    return out


def by_hand(order, parts, tags):
    """A file whose every tag is a list of 32-bit numbers; offsets are filled in."""
    starts, body = [], b""
    for p in parts:
        starts.append(8 + len(body))
        body += p
    fields = sorted({**tags, **{k: starts for k in tags if tags[k] == "starts"}, **{k: [len(p) for p in parts] for k in tags if tags[k] == "sizes"}}.items())
    extra, entries, tables = b"", b"", 8 + len(body)
    for tag, values in fields:
        packed = struct.pack(f"{order}{len(values)}I", *values)
        entries += struct.pack(f"{order}HHI", tag, 4, len(values)) + (packed if len(values) == 1 else struct.pack(f"{order}I", tables + len(extra)))
        extra += packed if len(values) > 1 else b""
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, tables + len(extra)) + body + extra + struct.pack(f"{order}H", len(fields)) + entries + b"\0" * 4


def test_round_trips_and_damage(spark):
    rng = np.random.default_rng(1)
    want, data = {}, []
    for i, kind in enumerate(["<u1", "<u2", ">u2", "<i2", "<f4", ">f4", "<f8", ">u4"]):
        for j, rows in enumerate((1, 3, 50)):
            a = (rng.random((11, 7)) * 200).astype(kind)
            want[10 * i + j] = a.astype(float)
            data.append((10 * i + j, bytearray(tiff.encoded(a, rows, (tiff.DEFLATE, tiff.NONE)[i % 2]))))
    whole = bytes(data[0][1])
    bad = [(900, bytearray(b"")), (901, None), (902, bytearray(b"II")), (903, bytearray(whole[:40])), (904, bytearray(whole[:8] + b"\xff" * 8 + whole[16:])), (905, bytearray(b"GIF89a" * 9))]
    got = tiff.decode(spark.createDataFrame(data + bad, SCHEMA), spread=3).collect()
    good = frames([r for r in got if r["error"] is None and r["image_id"] < 900])
    assert good.keys() == want.keys() and all(np.array_equal(good[k], want[k]) for k in want)
    assert {r["image_id"] for r in got if r["error"]} == {i for i, _ in bad}
    assert sum(r["image_id"] == 1 for r in got) == 4  # 11 rows in strips of three
    assert tiff.decode(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tiles_predictor_colours_and_runs(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1000, (20, 37)).astype(">u2")
    cells = [np.pad(a[y:y + 16, x:x + 16], ((0, 16 - len(a[y:y + 16])), (0, 16 - a[y:y + 16, x:x + 16].shape[1]))) for y in (0, 16) for x in (0, 16, 32)]
    differences = [np.diff(c, axis=1, prepend=c[:, :1] * 0).astype(">u2").tobytes() for c in cells]
    tiled = by_hand(">", differences, {256: [37], 257: [20], 258: [16], 259: [1], 277: [1], 317: [2], 322: [16], 323: [16], 324: "starts", 325: "sizes"})
    rgb = rng.integers(0, 255, (4, 5, 3)).astype("u1")
    colour = by_hand("<", [rgb.tobytes()], {256: [5], 257: [4], 258: [8, 8, 8], 259: [1], 273: "starts", 277: [3], 278: [4], 279: "sizes"})
    runs = by_hand("<", [bytes([2, 7, 8, 9, 254, 5, 128, 0, 1])], {256: [7], 257: [1], 258: [8], 259: [32773], 273: "starts", 277: [1], 278: [1], 279: "sizes"})
    got = frames(tiff.decode(spark.createDataFrame([(1, bytearray(tiled)), (2, bytearray(colour)), (3, bytearray(runs))], SCHEMA)).collect())
    assert np.array_equal(got[1], a) and np.allclose(got[2], rgb.mean(axis=2)) and got[3].tolist() == [[7, 8, 9, 5, 5, 5, 1]]


@pytest.mark.parametrize("compression", [5, 7])
def test_unknown_compression_is_an_error(spark, compression):
    blob = by_hand("<", [b"\0" * 4], {256: [2], 257: [2], 258: [8], 259: [compression], 273: "starts", 277: [1], 278: [2], 279: "sizes"})
    assert [r["error"] for r in tiff.decode(spark.createDataFrame([(1, bytearray(blob))], SCHEMA)).collect()] == ["ValueError"]
