"""Session construction and the shared scratch area used to cut long lineages."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "rasterloom", cpus: str | int = "*", shuffle: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RASTERLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so tile functions import wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "rasterloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


BATCH_BYTES = 16 << 20  # of an Arrow batch, which dense tiles fill long before its 10 000 rows
PART_CELLS = 1 << 20  # array cells that a worker's step holds at once, one row at least


def prepare(spark: SparkSession) -> None:
    """Ship this package to the workers and bound the bytes of an Arrow batch."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def in_parts(batches, cells):
    """Batches cut into runs of rows with about ``PART_CELLS`` cells each, by ``cells(pdf)``, the count of every row.

    What a step makes of a row can be many times the row, so a bound on what arrives is none on what is held.
    """
    import numpy as np

    for pdf in batches:
        part = np.cumsum(np.asarray(cells(pdf), dtype=np.int64)) // PART_CELLS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(pdf)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield pdf.iloc[a:b].reset_index(drop=True)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a machine-local folder, because there the driver and the tasks
    share one disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    A written table survives the loss of executors and, unlike a checkpoint,
    resets the size estimates that self-joins would otherwise multiply.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_key_stream(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """Apply ``fn`` to batches that each hold many whole key groups.

    Rows are co-located and sorted by ``keys``; a group that runs past the end of a batch is
    held back for the next one.  Unlike one call per group, thousands of small tiles cost
    one call, and memory stays at one batch plus one group.
    """
    def stream(batches):
        import pandas as pd

        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
            held = pdf[last]
            if not last.all():
                yield fn(pdf[~last])
        if held is not None and len(held):
            yield fn(held)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(stream, schema)
