"""Brush strokes to label state: batch form, stateful stream with undo, file drops and live counters.

Strokes are ordered by (ts, stroke_id) whenever they arrive; a watermark is an option of the caller, not a rule of the
operator.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scalars import content_id
from rasterloom.session import scratch_dir

UNDO_DEPTH = 30
PAINTED = 1 << 20  # pixels times strokes that are painted at once
GROUP_PIXELS, GROUP_FRAMES = 1 << 16, 64  # most that one row of stream state holds, one tile at least


def brush_pixels(strokes: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels of every stroke's disk, clipped to the frame."""
    r = F.col("radius")
    d = strokes.withColumn("_dy", F.explode(F.sequence(-r, r)))
    half = F.floor(F.sqrt(r * r - F.col("_dy") * F.col("_dy"))).cast("int")
    d = d.withColumn("_dx", F.explode(F.sequence(-half, half)))
    out = d.withColumns({"py": F.col("y") + F.col("_dy"), "px": F.col("x") + F.col("_dx")})
    return out.filter((F.col("py") >= 0) & (F.col("py") < height) & (F.col("px") >= 0) & (F.col("px") < width))


def stroke_labels(strokes: DataFrame, height: int, width: int) -> DataFrame:
    """Final label of every painted pixel: the last stroke wins, a clear wipes what came before it.

    Both are grouped maxima, so a frame with a third of all strokes needs no ordering.
    """
    at = F.struct("ts", "stroke_id")
    cleared = strokes.filter("mode = 'clear'").groupBy("image_id").agg(F.max(at).alias("_clear"))
    live = strokes.filter("mode <> 'clear'").join(cleared, "image_id", "left").filter(F.col("_clear").isNull() | (at > F.col("_clear")))
    px = brush_pixels(live, height, width)
    state = F.when(F.col("mode") == "crack", 1).otherwise(2)
    return px.groupBy("image_id", F.col("py").alias("y"), F.col("px").alias("x")).agg(F.max_by(state, at).alias("state"))


class TileLabels:
    """Label state of one tile: a raster of settled strokes, each pixel with its writer's (ts, id), and the newest strokes of the frame.

    The newest ``UNDO_DEPTH`` strokes stay live, in event order, so that an undo can take one back and a late stroke finds its
    place; older ones settle, and there a pixel keeps its latest writer.
    """

    def __init__(self, h: int, w: int, y0: int, x0: int, saved=None):
        import numpy as np

        self.shape, self.y0, self.x0 = (h, w), y0, x0
        self.live: list[tuple] = []  # (ts, id, mode, y, x, radius)
        self._old: list[tuple] = []  # pushed out of the live ones, not painted yet
        if saved is None:
            self.value, self.at = np.zeros((h, w), np.uint8), np.full((h, w, 2), np.iinfo(np.int64).min)
        else:
            self.value = np.frombuffer(saved[0], np.uint8).reshape(h, w).copy()
            self.at = np.frombuffer(saved[1], np.int64).reshape(h, w, 2).copy()
            self.live = list(zip(*saved[2:]))

    def saved(self) -> tuple:
        self._settle()
        columns = list(zip(*self.live)) if self.live else [()] * 6
        return (self.value.tobytes(), self.at.tobytes(), *[list(c) for c in columns])

    def _hits(self, stroke) -> bool:
        """Whether the stroke's box meets the tile."""
        _, _, mode, y, x, radius = stroke
        return mode == "clear" or (self.y0 - radius <= y < self.y0 + self.shape[0] + radius and self.x0 - radius <= x < self.x0 + self.shape[1] + radius)

    def _paint(self, strokes, value, at) -> None:
        """Every pixel takes the latest of its writer in ``at`` and the strokes over it, all at once but for large tiles."""
        import numpy as np

        strokes = sorted(filter(self._hits, strokes))
        ys, xs = np.arange(self.shape[0]) + self.y0, np.arange(self.shape[1]) + self.x0
        for part in (strokes[i:i + self._at_once()] for i in range(0, len(strokes), self._at_once())):
            stamps = np.array([s[:2] for s in part], np.int64)
            clear = np.array([s[2] == "clear" for s in part])
            cy, cx, radius = np.array([s[3:6] for s in part], np.int64).T
            dy, dx = (ys - cy[:, None]) ** 2, (xs - cx[:, None]) ** 2
            over = (dy[:, :, None] + dx[:, None, :] <= (radius * radius)[:, None, None]) | clear[:, None, None]
            last = len(part) - 1 - over[::-1].argmax(0)
            ts, ident = stamps[last, 0], stamps[last, 1]
            # A late stroke may be older than what has settled below it.
            hit = over.any(0) & ((at[..., 0] < ts) | ((at[..., 0] == ts) & (at[..., 1] < ident)))
            wrote = np.array([0 if s[2] == "clear" else 1 if s[2] == "crack" else 2 for s in part], np.uint8)
            value[hit], at[hit] = wrote[last[hit]], stamps[last[hit]]

    def _at_once(self) -> int:
        return max(1, PAINTED // (self.shape[0] * self.shape[1]))

    def _settle(self) -> None:
        if self._old:
            self._paint(self._old, self.value, self.at)
            self._old = []

    def add(self, stroke: tuple) -> None:
        """One event; undo takes the newest live stroke before it."""
        if stroke[2] == "undo":
            before = bisect_left(self.live, stroke[:2])
            if before:
                del self.live[before - 1]
            return
        insort(self.live, stroke)
        if len(self.live) > UNDO_DEPTH:
            self._old.append(self.live.pop(0))

    def raster(self):
        self._settle()
        out = self.value.copy()
        self._paint(self.live, out, self.at.copy())
        return out


STATE = ("version bigint, frames array<bigint>, counts array<int>, value binary, at binary, ts array<bigint>, ids array<bigint>, modes array<string>, "
         "ys array<int>, xs array<int>, radii array<int>")
CHANGES = "image_id bigint, version bigint, y int, x int, state int"


def stroke_stream(strokes: DataFrame, height: int, width: int, tile: int = 256) -> DataFrame:
    """Streaming label state with undo of a frame's last 30 strokes.

    State is held per tile and every stroke goes to all tiles of its frame as one small row.  A stroke that arrives late takes its
    place by (ts, stroke_id), as in the batch form.  Small tiles at the same place of frames with neighbouring numbers share a state
    row, up to ``GROUP_PIXELS`` and ``GROUP_FRAMES``, since a call costs far more than a small tile.  Emits the changed pixels of
    each micro-batch; state 0 is no label.
    """
    frames = max(1, min(GROUP_FRAMES, GROUP_PIXELS // (tile * tile)))

    def update(key, batches, state):
        import numpy as np
        import pandas as pd

        ty, tx = int(key[1]), int(key[2])
        y0, x0 = ty * tile, tx * tile
        h, w = min(tile, height - y0), min(tile, width - x0)
        version, held = 0, {}
        if state.exists:
            version, names, counts, value, at, *live = state.get
            ends, size = np.cumsum([0, *counts]).tolist(), h * w
            held = {f: (value[i * size:(i + 1) * size], at[16 * i * size:16 * (i + 1) * size], *[c[ends[i]:ends[i + 1]] for c in live])
                    for i, f in enumerate(names)}
        events = {}
        for pdf in batches:
            stamps = pdf["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            names = [None] * len(pdf) if pd.isna(key[0]) else pdf["image_id"].tolist()
            for f, *event in zip(names, stamps, *(pdf[c].tolist() for c in ("stroke_id", "mode", "y", "x", "radius"))):
                events.setdefault(f, []).append(tuple(event))
        out = []
        for f, new in events.items():
            labels = TileLabels(h, w, y0, x0, held.get(f))
            before = labels.raster()
            for event in sorted(new):
                labels.add(event)
            after = labels.raster()
            held[f] = labels.saved()
            ys, xs = np.nonzero(before != after)
            out.append((np.full(len(ys), f), ys + y0, xs + x0, after[ys, xs]))
        live = [[v for s in held.values() for v in s[i]] for i in range(2, 8)]
        state.update((version + 1, list(held), [len(s[2]) for s in held.values()], *[b"".join(s[i] for s in held.values()) for i in (0, 1)], *live))
        names, ys, xs, states = (np.concatenate(c) for c in zip(*out))
        if len(ys):
            yield pd.DataFrame({"image_id": names, "version": version + 1, "y": ys.astype("int32"), "x": xs.astype("int32"), "state": states.astype("int32")})

    spread = lambda name, size: F.explode(F.sequence(F.lit(0), F.lit((size - 1) // tile))).alias(name)
    tiled = strokes.select("image_id", "ts", "stroke_id", "mode", "y", "x", "radius", spread("ty", height)).select("*", spread("tx", width))
    keyed = tiled.withColumn("pack", F.expr(f"image_id div {frames}"))
    return keyed.groupBy("pack", "ty", "tx").applyInPandasWithState(update, CHANGES, STATE, "update", "NoTimeout")


def new_base(spark, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, schema: str, mode: str, base: str) -> DataFrame:
    """Drain the available input under the folder ``base``, going on from its last drain.

    Every micro-batch replaces its own folder, so a retried batch cannot double.
    """
    spark = stream.sparkSession

    def upsert(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(upsert).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema + ", epoch bigint").parquet(f"{base}/rows")


def latest_labels(changes: DataFrame) -> DataFrame:
    """Label rows left by the last change of every pixel."""
    last = changes.groupBy("image_id", "y", "x").agg(F.max_by("state", "version").alias("state"))
    return last.filter("state > 0")


def in_turn(df: DataFrame, batch: Column, label: str, drain) -> DataFrame:
    """``df`` as a stream whose input arrives in rising order of ``batch``; ``drain(stream, base)`` takes in what is there.

    Each value's rows are written by Spark's own tasks and drained as one micro-batch before the next ones arrive.
    """
    spark = df.sparkSession
    base = new_base(spark, label)
    out = None
    for (value,) in df.select(batch.alias("b")).distinct().orderBy("b").collect() or [(None,)]:
        (df if value is None else df.filter(batch == value)).write.mode("append").parquet(f"{base}/arrived")
        out = drain(spark.readStream.schema(df.schema).parquet(f"{base}/arrived"), base)
    return out


def ingest_drops(files: DataFrame, base: str) -> DataFrame:
    """Drains a file-drop stream into a table under ``base`` with one row per content id, going on from the last drain.

    Each micro-batch is compared with what the table holds, so no ids are kept in stream state; a batch writes its own
    folder, so a retried batch reads the others' rows only.
    """
    spark = files.sparkSession
    schema = "ident string, epoch bigint"
    spark.createDataFrame([], "ident string").write.mode("ignore").parquet(f"{base}/rows/epoch=-1")

    def upsert(batch: DataFrame, epoch: int) -> None:
        held = spark.read.schema(schema).parquet(f"{base}/rows").filter(F.col("epoch") != epoch)
        new = batch.select(content_id(F.col("name"), F.col("content")).alias("ident")).distinct().join(held, "ident", "left_anti")
        new.write.mode("overwrite").parquet(f"{base}/rows/epoch={epoch}")

    files.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/rows")


def live_counters(strokes: DataFrame) -> DataFrame:
    """Running stroke counters per frame."""
    return strokes.groupBy("image_id").agg(F.count_if(F.col("mode") == "crack").alias("n_pos"), F.count_if(F.col("mode") == "erase").alias("n_neg"))

