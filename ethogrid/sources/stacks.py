"""Ordered stacks of frames as a data source and sink: `.npy` files of (frame, height, width, channel).

A video is one or more files `<video>.npy` or `<video>.<first frame>.npy`; its frames count on from the
first one of each file. Files lie in a folder that the driver and the executors see (a mounted one).
"""

from __future__ import annotations

import glob
import io
import os
import re
import shutil
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = "video string, frame long, height int, width int, channels int, pixels binary"
NAME = re.compile(r"^(?P<video>.+?)(?:\.(?P<first>\d{12}))?\.npy$")
END = 1 << 60


class FrameStacks(DataSource):
    """Options: path, frames (a partition's frames, 256), first and last (a range of frames to read), push (whether filters are
    taken), segment (a file's frames when written, 4096). A file is mapped, so only the pages read are loaded.

    With push, and spark.sql.python.filterPushdown.enabled set, filters on video and frame reach the source: files of other
    videos aren't opened, and partitions outside the frames aren't planned. Spark keeps what it has pushed with the data frame, and would
    go by it when the same frame is used again with other filters; so push is for a frame that is used once.
    """

    @classmethod
    def name(cls) -> str:
        return "frame_stacks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteredReader if str(self.options.get("push", "false")).lower() == "true" else StackReader)(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return StackWriter(self.options, [f.name for f in schema.fields], overwrite)


def _local(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"stacks need a mounted folder: {path}")
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


class StackReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = _local(options["path"]), int(options.get("frames", 256))
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", END))
        self.videos: set[str] | None = None

    def partitions(self) -> list[InputPartition]:
        out = []
        for file in sorted(glob.glob(f"{glob.escape(self.path)}/*.npy")):
            named = NAME.match(os.path.basename(file))
            if self.videos is not None and named["video"] not in self.videos:
                continue
            begin, n = int(named["first"] or 0), np.load(file, mmap_mode="r").shape[0]
            low, high = max(self.first, begin), min(begin + n, self.last + 1)
            out += [InputPartition((file, named["video"], begin, a, min(a + self.size, high))) for a in range(low, high, self.size)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        file, video, begin, low, high = partition.value
        stack = np.load(file, mmap_mode="r")
        for frame in range(low, high):
            pixels = np.ascontiguousarray(stack[frame - begin])
            h, w, c = pixels.shape
            yield video, frame, h, w, c, pixels.tobytes()


class FilteredReader(StackReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and lists of videos, and bounds of frames; the others are left to Spark."""
        for f in filters:
            video, frame = getattr(f, "attribute", None) == ("video",), getattr(f, "attribute", None) == ("frame",)
            if video and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.videos = named if self.videos is None else self.videos & named
            elif frame and isinstance(f, EqualTo) and f.value is not None:
                self.first, self.last = max(self.first, f.value), min(self.last, f.value)
            elif frame and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif frame and isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, f.value - isinstance(f, LessThan))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: where each lies until the commit, and its name."""

    files: list[tuple[str, str]]


def _head(shape: tuple[int, ...]) -> bytes:
    """The head of a stack file; its length doesn't depend on the number of frames."""
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": "|u1", "fortran_order": False, "shape": shape})
    return out.getvalue()


class StackWriter(DataSourceWriter):
    """Rows come ordered, a segment of a video in one task (write_stacks sees to that). A task streams them into files of its own
    in a hidden folder; the driver names them when all tasks have ended, and removes the folder if one has failed for good, so a
    reader sees all of a write or nothing of it, and files of failed attempts go with the folder."""

    def __init__(self, options, columns: list[str], overwrite: bool):
        self.path, self.segment, self.columns, self.overwrite = _local(options["path"]), int(options.get("segment", 4096)), columns, overwrite
        self.hidden = f"{self.path}/.{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.hidden, exist_ok=True)
        files, now, out, shape, n = [], None, None, None, 0

        def shut() -> None:
            if out:
                out.seek(0)
                out.write(_head((n, *shape)))
                out.close()

        for r in rows:
            row = dict(zip(self.columns, r, strict=True))
            size, at = (row["height"], row["width"], row["channels"]), (row["video"], row["frame"] // self.segment)
            if at != now:
                shut()
                now, shape, n = at, size, 0
                if not row["video"] or "/" in row["video"]:
                    raise ValueError(f"not a name of a file: {row['video']!r}")
                first = row["frame"]
                temporary = f"{self.hidden}/{uuid.uuid4().hex}"
                files.append((temporary, f"{row['video']}.{first:012d}.npy"))
                out = open(temporary, "wb")  # noqa: SIM115  closed by shut()
                out.write(_head((END, *shape)))
            if size != shape or row["frame"] != first + n or len(row["pixels"]) != size[0] * size[1] * size[2]:
                raise ValueError(f"frames of {row['video']!r} leave gaps, or differ in shape, at {row['frame']}")
            out.write(row["pixels"])
            n += 1
        shut()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        named = [f for m in messages if m for f in m.files]
        if len({n for _, n in named}) < len(named):
            self.abort(messages)
            raise ValueError("a segment of a video was written by several tasks; use write_stacks")
        if self.overwrite:
            for old in glob.glob(f"{glob.escape(self.path)}/*.npy"):
                os.remove(old)
        for temporary, name in named:
            os.replace(temporary, f"{self.path}/{name}")
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


def write_stacks(rows: DataFrame, path: str, segment: int = 4096) -> None:
    """The frames as stacks, replacing those in the folder. A video's frames have no gaps and one shape; a segment of so many of
    them is a file and one task's work, so a long video is shared among tasks."""
    rows.sparkSession.dataSource.register(FrameStacks)
    part = F.floor(F.col("frame") / segment).alias("part")
    ordered = rows.select(*[c.split()[0] for c in SCHEMA.split(", ")], part).repartition("video", "part").sortWithinPartitions("video", "frame").drop("part")
    ordered.write.format("frame_stacks").option("path", path).option("segment", segment).mode("overwrite").save()


def read_stacks(spark: SparkSession, path: str, where: Column | str | None = None) -> DataFrame:
    """All frames of a folder's stacks, or those of a condition, whose bounds on video and frame then reach the source (such a
    frame is for one use). Files that are replaced later have to be read anew: Spark plans a frame's partitions once."""
    spark.dataSource.register(FrameStacks)
    rows = spark.read.format("frame_stacks").option("path", path)
    if where is None:
        return rows.load()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return rows.option("push", "true").load().where(where)
