"""Frame sources: discovery, decoding, channel collapse, truth and packed layers, upserts and load plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.scalars import content_id, stem
from rasterloom.session import in_parts

# Readable raster extensions.
READABLE = ("tif", "tiff", "png", "jpg", "jpeg", "bmp", "npy", "raw")


def select_frames(listing: DataFrame, extensions: Sequence[str] = READABLE, exclude: Sequence[str] = ()) -> DataFrame:
    """From a listing with ``path``: readable, not excluded, one row per name (first path), group = parent folder."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    base = F.regexp_replace("path", r"^.*/", "")
    ok = ext.isin(*extensions)
    for word in exclude:
        ok = ok & ~base.contains(word)
    named = listing.filter(ok).select(stem(F.col("path")).alias("name"), "path")
    first = named.groupBy("name").agg(F.min("path").alias("path"))
    return first.select("name", "path", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("grp"))


def scan_frames(spark: SparkSession, folder: str, extensions: Sequence[str] = READABLE, exclude: Sequence[str] = ()) -> DataFrame:
    """Recursive discovery under ``folder``; only names are listed, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    return select_frames(files, extensions, exclude).join(files, "path")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """PNG, JPEG and BMP frames as pixel planes ``(image_id, nchan, c, y, x, v)``, channels in stored order."""
    img = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    px = img.select(stem(F.col("origin")).alias("image_id"), F.col("nChannels").alias("nchan"), "width",
                    F.posexplode(F.transform(F.sequence(F.lit(1), F.length("data")), lambda i: F.conv(F.hex(F.substring(F.col("data"), i, F.lit(1))), 16, 10).cast("int"))).alias("_i", "v"))
    cell = F.floor(F.col("_i") / F.col("nchan"))
    return px.select("image_id", "nchan", (F.col("_i") % F.col("nchan")).alias("c"), F.floor(cell / F.col("width")).cast("int").alias("y"),
                     (cell % F.col("width")).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def decode_arrays(files: DataFrame) -> DataFrame:
    """Decode ``.npy`` content ``(image_id, content)`` to one tile per frame; ``error`` holds the first failure of a bad one."""
    kind = dict(files.dtypes)["image_id"]
    schema = f"image_id {kind}, ty int, tx int, y0 int, x0 int, h int, w int, fh int, fw int, data array<double>, error string"

    def decode(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in in_parts(batches, lambda p: [1 + len(c or b"") // 8 for c in p["content"]]):
            rows = []
            for ident, blob in zip(pdf["image_id"], pdf["content"]):
                try:
                    a = np.load(io.BytesIO(bytes(blob)), allow_pickle=False)
                    a = a if a.ndim == 2 else (a.mean(axis=-1) if a.ndim == 3 and a.shape[-1] in (3, 4) else a[0])
                    h, w = a.shape
                    rows.append((ident, 0, 0, 0, 0, h, w, h, w, a.astype(float).ravel(), None))
                except Exception as exc:  # noqa: BLE001  a bad file goes to quarantine, not to a failed job
                    rows.append((ident, 0, 0, 0, 0, 0, 0, 0, 0, None, type(exc).__name__))
            yield pd.DataFrame(rows, columns=["image_id", "ty", "tx", "y0", "x0", "h", "w", "fh", "fw", "data", "error"])

    return files.select("image_id", "content").mapInPandas(decode, schema)


def encode_arrays(tiles: DataFrame) -> DataFrame:
    """One-tile frames to ``.npy`` content."""
    kind = dict(tiles.dtypes)["image_id"]

    def encode(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in in_parts(batches, lambda p: p["h"] * p["w"]):
            blobs = []
            for h, w, data in zip(pdf["h"], pdf["w"], pdf["data"]):
                out = io.BytesIO()
                np.save(out, np.asarray(data).reshape(h, w))
                blobs.append(out.getvalue())
            yield pd.DataFrame({"image_id": pdf["image_id"], "content": blobs})

    return tiles.select("image_id", "h", "w", "data").mapInPandas(encode, f"image_id {kind}, content binary")


def collapse_planes(planes: DataFrame) -> DataFrame:
    """Three or four channels become their mean, any other count its first plane."""
    colour = F.col("nchan").isin(3, 4)
    return planes.groupBy("image_id", "y", "x").agg(
        F.when(F.first(colour), F.avg("v")).otherwise(F.min_by("v", "c")).alias("v"))


def discover_truth(images: DataFrame, masks: DataFrame, shipped: Sequence[str]) -> DataFrame:
    """Stems with both an image and a mask, plus the shipped list, which always comes first."""
    both = images.select("stem").join(masks.select("stem"), "stem", "left_semi").distinct()
    ship = both.sparkSession.createDataFrame([(s,) for s in shipped], "stem string")
    rest = both.filter(~F.col("stem").isin(*shipped)).withColumn("shipped", F.lit(False))
    return ship.withColumn("shipped", F.lit(True)).union(rest)


def truth_from_probability(prob: DataFrame, frames: DataFrame) -> DataFrame:
    """Truth pixels from probability maps that may be scaled to 255; frames of another shape are skipped."""
    top = prob.groupBy("image_id").agg(F.max("p").alias("_max"))
    ok = frames.filter("height = p_height AND width = p_width").select("image_id")
    scale = F.when(F.col("_max") > 1.5, 255.0).otherwise(1.0)
    return prob.join(ok, "image_id", "left_semi").join(top, "image_id").select("image_id", "y", "x", (F.col("p") / scale >= 0.5).alias("is_pos"))


def expand_packed(packed: DataFrame, existing: DataFrame, width: int) -> DataFrame:
    """16-bit frames ``(image_id, u16)`` to pixels in [0, 1]; frames already present are left out."""
    new = packed.join(existing.select("image_id"), "image_id", "left_anti")
    return new.select("image_id", F.posexplode("u16").alias("_i", "u")).select(
        "image_id", F.floor(F.col("_i") / width).cast("int").alias("y"), (F.col("_i") % width).cast("int").alias("x"), (F.col("u") / 65535.0).alias("v"))


def ingest_upsert(files: DataFrame, existing: DataFrame) -> DataFrame:
    """New frames only: the id is slug plus content hash, so equal content under one name is one frame."""
    ident = files.select(content_id(F.col("name"), F.col("content")).alias("ident"), "name", "file_id")
    first = ident.groupBy("ident").agg(F.min("name").alias("name"), F.min("file_id").alias("file_id"))
    return first.join(existing.select("ident"), "ident", "left_anti")


def load_plan(files: DataFrame, frames: DataFrame, predictions: DataFrame, model_key: str) -> DataFrame:
    """Action per file: skip when the same file name is ready, or already predicted by the current model."""
    done = predictions.filter(F.col("model_key") == model_key).select("image_id").distinct().withColumn("_done", F.lit(True))
    j = files.join(frames.select("filename", "image_id", "status"), "filename", "left").join(done, "image_id", "left")
    action = F.when(F.col("status") == "ready", "skip: ready").when(F.col("_done"), "skip: predicted").otherwise("load")
    return j.select("filename", action.alias("action"))

