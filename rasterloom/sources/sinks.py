"""Sinks: region and summary exports, mask images as rows, and the label archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_regions_csv(regions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per frame, rows by falling area; frames are split over tasks by size, not one task each."""
    regions.repartitionByRange("image_id", F.desc("area")).sortWithinPartitions("image_id", F.desc("area")).write.partitionBy(
        "image_id").option("header", True).mode(mode).csv(path)


def write_summary(summary: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    writer = summary.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def mask_bytes(px: DataFrame, mask: str = "is_pos") -> DataFrame:
    """Mask as image values: positive 0, background 255."""
    return px.select("image_id", "y", "x", F.when(F.col(mask), 0).otherwise(255).alias("v"))


def write_predictions(probs: DataFrame, path: str, mode: str = "append") -> None:
    """Probability maps partitioned by model, so one model's maps are read without the others."""
    probs.write.partitionBy("model_key").mode(mode).parquet(path)


def write_label_archive(runs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Run-length label archive, clustered by frame."""
    runs.repartitionByRange("image_id", "y").write.option("compression", "zstd").mode(mode).parquet(path)
