"""TIFF frames as strips: the directory becomes rows, each strip carries its own bytes and is decoded by itself."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.session import in_parts

# Tags, and bytes of the field types, of the TIFF 6.0 format.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 284, 317, 322, 323, 324, 325, 339
FIELD_CODES = {1: "B", 3: "H", 4: "I", 16: "Q"}
NONE, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 8, 32946, 32773

PART = "struct<no: int, at: bigint, size: bigint, y0: int, x0: int, h: int, w: int, bw: int>"


def directory(blob: bytes) -> tuple[dict, list[tuple]]:
    """Shape and sample type of the first image, and its strips or tiles as (no, at, size, y0, x0, h, w, width in the file)."""
    order = {b"II": "<", b"MM": ">"}[blob[:2]]
    magic, at = struct.unpack_from(f"{order}HI", blob, 2)
    if magic != 42:
        raise ValueError("not a TIFF file")
    tags = {}
    (n,) = struct.unpack_from(f"{order}H", blob, at)
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", blob, at + 2 + 12 * i)
        if kind not in FIELD_CODES:
            continue
        code = FIELD_CODES[kind]
        place = at + 10 + 12 * i
        if struct.calcsize(code) * count > 4:
            (place,) = struct.unpack_from(f"{order}I", blob, place)
        tags[tag] = struct.unpack_from(f"{order}{count}{code}", blob, place)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    h, w, samples, bits = one(HEIGHT), one(WIDTH), one(SAMPLES, 1), one(BITS, 1)
    if bits not in (8, 16, 32, 64) or (samples > 1 and one(PLANAR, 1) != 1):
        raise ValueError("unsupported sample layout")
    kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
    head = {"fh": h, "fw": w, "samples": samples, "dtype": f"{order}{kind}{bits // 8}", "compression": one(COMPRESSION, NONE), "predictor": one(PREDICTOR, 1)}
    tiled = TILE_OFFSETS in tags
    bh, bw = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS, h), h), w)
    across = -(-w // bw)
    parts = []
    for no, (start, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS])):
        y0, x0 = no // across * bh, no % across * bw
        if start + size > len(blob):
            raise ValueError("truncated")
        parts.append((no, start, size, y0, x0, min(bh, h - y0), min(bw, w - x0), bw))
    return head, parts


def unpacked_bits(data: bytes) -> bytes:
    """PackBits runs written out."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1:at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1:at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def part_values(data: bytes, compression: int, predictor: int, dtype: str, samples: int, h: int, w: int, bw: int) -> np.ndarray:
    """Values of one strip or tile, (h, w); three or four samples become their mean, any other count its first."""
    if compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif compression == PACKBITS:
        data = unpacked_bits(data)
    elif compression != NONE:
        raise ValueError(f"compression {compression}")
    kind = np.dtype(dtype)
    a = np.frombuffer(data, kind, count=h * bw * samples).reshape(h, bw, samples)
    if predictor == 2:
        a = np.cumsum(a, axis=1, dtype=kind.newbyteorder("="))
    elif predictor != 1:
        raise ValueError(f"predictor {predictor}")
    a = a[:, :w].astype(float)
    return a.mean(axis=2) if samples in (3, 4) else a[:, :, 0]


ROW_CELLS = 512  # what a row's Python objects take beside its samples


def file_cells(pdf):
    return [ROW_CELLS + len(c or b"") // 8 for c in pdf["content"]]


def strips(files: DataFrame) -> DataFrame:
    """``(image_id, content)`` to one row per strip or tile with its own bytes; ``error`` holds the failure of a bad directory."""
    kind = dict(files.dtypes)["image_id"]
    head = "fh int, fw int, samples int, dtype string, compression int, predictor int"

    def read(batches):
        import pandas as pd

        for pdf in in_parts(batches, file_cells):
            rows = []
            for blob in pdf["content"]:
                try:
                    found, parts = directory(bytes(blob))
                    rows.append((*found.values(), [dict(zip(("no", "at", "size", "y0", "x0", "h", "w", "bw"), p)) for p in parts], None))
                except Exception as exc:  # noqa: BLE001  a bad file goes to quarantine, not to a failed job
                    rows.append((0, 0, 0, None, 0, 0, [], type(exc).__name__))
            made = pd.DataFrame(rows, columns=["fh", "fw", "samples", "dtype", "compression", "predictor", "parts", "error"])
            yield pd.concat([pdf[["image_id", "content"]].reset_index(drop=True), made], axis=1)

    listed = files.select("image_id", "content").mapInPandas(read, f"image_id {kind}, content binary, {head}, parts array<{PART}>, error string")
    each = listed.withColumn("p", F.explode_outer("parts"))
    cut = F.substring(F.col("content"), (F.col("p.at") + 1).cast("int"), F.col("p.size").cast("int"))
    return each.select("image_id", "fh", "fw", "samples", "dtype", "compression", "predictor", "p.no", "p.y0", "p.x0", "p.h", "p.w", "p.bw", cut.alias("bytes"), "error")


def decode(files: DataFrame, spread: int | None = None) -> DataFrame:
    """TIFF content to tiles ``(image_id, no, y0, x0, h, w, fh, fw, data, error)``, one per strip or tile of the file.

    Strips are decoded apart, so a tall frame needs no worker that holds it decoded; with ``spread`` they are dealt to that many
    tasks first, which pays for few large files.  Reads 8 to 64 bit samples that are plain, deflated or PackBits, of
    either byte order, in strips or tiles, with or without the horizontal predictor; of several pages the first.
    """
    kind = dict(files.dtypes)["image_id"]

    def run(batches):
        import pandas as pd

        for pdf in in_parts(batches, lambda p: ROW_CELLS + p["h"].fillna(0) * p["w"].fillna(0)):
            data, errors = [], []
            for r in pdf.itertuples(index=False):
                try:
                    data.append(None if r.error else part_values(bytes(r.bytes), r.compression, r.predictor, r.dtype, r.samples, int(r.h), int(r.w), int(r.bw)).ravel())
                    errors.append(r.error)
                except Exception as exc:  # noqa: BLE001
                    data.append(None)
                    errors.append(type(exc).__name__)
            out = pdf[["image_id", "no", "y0", "x0", "h", "w", "fh", "fw"]].copy()
            yield out.assign(data=data, error=errors)

    found = strips(files)
    if spread:
        found = found.repartition(spread)
    return found.mapInPandas(run, f"image_id {kind}, no int, y0 int, x0 int, h int, w int, fh int, fw int, data array<double>, error string")


def encoded(a: np.ndarray, rows: int, compression: int = DEFLATE) -> bytes:
    """One-sample frame of the array's own type and byte order, in strips of ``rows`` rows."""
    order = ">" if a.dtype.str[0] == ">" else "<"
    parts = [a[y:y + rows].tobytes() for y in range(0, len(a), rows)]
    if compression == DEFLATE:
        parts = [zlib.compress(p) for p in parts]
    starts = np.cumsum([8, *map(len, parts)]).tolist()
    tables = starts[-1] + starts[-1] % 2
    fields = [(WIDTH, a.shape[1]), (HEIGHT, a.shape[0]), (BITS, a.itemsize * 8), (COMPRESSION, compression), (262, 1), (OFFSETS, starts[:-1]),
              (SAMPLES, 1), (ROWS, rows), (COUNTS, [len(p) for p in parts]), (FORMAT, {"u": 1, "i": 2, "f": 3}[a.dtype.kind])]
    entries, extra = b"", b""
    for tag, value in fields:
        many = value if isinstance(value, list) else [value]
        packed = struct.pack(f"{order}{len(many)}I", *many)
        entries += struct.pack(f"{order}HHI", tag, 4, len(many))
        if len(many) == 1:
            entries += packed
        else:
            entries += struct.pack(f"{order}I", tables + len(extra))
            extra += packed
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, tables + len(extra))
    body = b"".join(parts)
    return head + body + b"\0" * (tables - 8 - len(body)) + extra + struct.pack(f"{order}H", len(fields)) + entries + struct.pack(f"{order}I", 0)


def encode(tiles: DataFrame, rows: int) -> DataFrame:
    """One-tile frames to TIFF content of 64-bit samples; odd ids are big-endian and plain, even ones little-endian and deflated."""
    kind = dict(tiles.dtypes)["image_id"]

    def run(batches):
        import pandas as pd

        for pdf in in_parts(batches, lambda p: ROW_CELLS + p["h"] * p["w"]):
            blobs = []
            for ident, h, w, data in zip(pdf["image_id"], pdf["h"], pdf["w"], pdf["data"]):
                a = np.asarray(data).reshape(h, w)
                blobs.append(encoded(a.astype(">f8"), rows, NONE) if ident % 2 else encoded(a.astype("<f8"), rows))
            yield pd.DataFrame({"image_id": pdf["image_id"], "content": blobs})

    return tiles.select("image_id", "h", "w", "data").mapInPandas(run, f"image_id {kind}, content binary")
