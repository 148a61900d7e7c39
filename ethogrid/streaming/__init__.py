"""Incremental forms of the ordered operators, by Structured Streaming.

Stateful operators are keyed by video; a micro-batch's rows are sorted by frame, and frames that come
again or late (at or before the last one seen) are dropped, as the state holds no older frames.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ethogrid.session import checkpointing


def stream_of(spark: SparkSession, path: str, per_batch: int = 8) -> DataFrame:
    """A table's files as a stream, with the schema of the files; the path may be a folder or a file."""
    # a stream takes a single file only by a pattern, here of the last letter
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there now and return what it appended, from the shared checkpoint folder."""
    spark = checkpointing(stream.sparkSession)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def _ordered(batches: Iterator[pd.DataFrame], last: int) -> pd.DataFrame:
    rows = pd.concat(list(batches)).sort_values("frame", kind="stable").drop_duplicates("frame")
    return rows[rows["frame"] > last]


def closed_runs(frames: DataFrame) -> DataFrame:
    """video, run, label, start, end, n of runs that a later frame has ended; state: the open run."""

    def step(key, batches, state: GroupState):
        run, label, start, end = state.get if state.exists else (0, None, -1, -1)
        out = []
        for frame, now in _ordered(batches, end)[["frame", "label"]].itertuples(index=False):
            if run == 0 or now != label:
                if run:
                    out.append((key[0], run, label, start, end, end - start + 1))
                run, label, start = run + 1, now, frame
            end = frame
        state.update((int(run), label, int(start), int(end)))
        yield pd.DataFrame(out, columns=["video", "run", "label", "start", "end", "n"])

    return frames.select("video", "frame", "label").groupBy("video").applyInPandasWithState(
        step, "video long, run long, label string, start long, end long, n long", "run long, label string, start long, last long", "append", GroupStateTimeout.NoTimeout
    )


def speeds(frames: DataFrame) -> DataFrame:
    """video, frame, speed; state: the last position. A position that is missing gives no speed to its neighbours."""

    def step(key, batches, state: GroupState):
        last, x, y = state.get if state.exists else (-1, None, None)
        rows = _ordered(batches, last)[["frame", "x", "y"]]
        out = []
        for frame, nx, ny in rows.itertuples(index=False):
            missing = any(v is None or v != v for v in (x, y, nx, ny))
            out.append((key[0], frame, 0.0 if last < 0 else None if missing else ((nx - x) ** 2 + (ny - y) ** 2) ** 0.5))
            last, x, y = frame, nx, ny
        none = lambda v: None if v is None or v != v else float(v)
        state.update((int(last), none(x), none(y)))
        yield pd.DataFrame(out, columns=["video", "frame", "speed"])

    return frames.select("video", "frame", "x", "y").groupBy("video").applyInPandasWithState(
        step, "video long, frame long, speed double", "last long, x double, y double", "append", GroupStateTimeout.NoTimeout
    )


def memory(frames: DataFrame, gap: int, blocks: int) -> DataFrame:
    """video, seen, kept: after each micro-batch, the frames of a bounded memory that takes every gap-th frame and keeps the newest."""

    def step(key, batches, state: GroupState):
        last, kept = state.get if state.exists else (-1, [])
        rows = _ordered(batches, last)
        new = [int(f) for f in rows["frame"] if f % gap == 0]
        last = int(rows["frame"].max()) if len(rows) else last
        kept = (new[::-1] + list(kept))[:blocks]
        state.update((last, kept))
        yield pd.DataFrame({"video": [key[0]], "seen": [last], "kept": [kept]})

    return frames.select("video", "frame").groupBy("video").applyInPandasWithState(
        step, "video long, seen long, kept array<long>", "last long, kept array<long>", "append", GroupStateTimeout.NoTimeout
    )


def window_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """begin, kind, n, total of tumbling windows that the watermark has closed."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", window), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("begin"), "kind", "n", "total")


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without those that come again within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
