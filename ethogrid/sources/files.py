"""Rows as files: labels, indexed images and any other bytes, written all or none.

Rows are (name, content); a name may hold folders. Files lie in a folder that the driver and the executors see (a mounted one).
"""

from __future__ import annotations

import io
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .stacks import _local


class Blobs(DataSource):
    """Option: path, the folder."""

    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BlobWriter(self.options)


@dataclass
class Named(WriterCommitMessage):
    """A task's files: where each lies until the commit, and its name."""

    files: list[tuple[str, str]]


class BlobWriter(DataSourceWriter):
    """Tasks write to a hidden folder; the driver names the files when all have ended, over those of the same names, or removes the folder."""

    def __init__(self, options):
        self.path = _local(options["path"])
        self.hidden = f"{self.path}/.{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Named:
        os.makedirs(self.hidden, exist_ok=True)
        files = []
        for name, content in rows:
            parts = (name or "").split("/")
            if content is None or any(p in ("", ".", "..") for p in parts):
                raise ValueError(f"not a file: {name!r}")
            files.append((f"{self.hidden}/{uuid.uuid4().hex}", name))
            with open(files[-1][0], "wb") as f:
                f.write(content)
        return Named(files)

    def commit(self, messages: list[Named | None]) -> None:
        named = [f for m in messages if m for f in m.files]
        if len({n for _, n in named}) < len(named):
            self.abort(messages)
            raise ValueError("two rows have one name")
        for temporary, name in named:
            os.makedirs(os.path.dirname(f"{self.path}/{name}"), exist_ok=True)
            os.replace(temporary, f"{self.path}/{name}")
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list[Named | None]) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


def write_blobs(rows: DataFrame, path: str) -> None:
    """name and content as files below the folder; files of other names stay."""
    rows.sparkSession.dataSource.register(Blobs)
    rows.select("name", "content").write.format("blobs").option("path", path).mode("append").save()


def promoted(masks: DataFrame, frames: DataFrame, chosen: DataFrame) -> DataFrame:
    """video, frame, height, width, channels, pixels, mask: tracked masks (video, frame, mask) of the chosen (video, frame) as labels, with their frames."""
    keys = ["video", "frame"]
    return frames.join(chosen.select(*keys).distinct(), keys).join(masks.select(*keys, "mask"), keys)


def write_labels(labels: DataFrame, path: str) -> None:
    """Labels as <video>/<frame>.npz with the arrays frame and mask, over those that exist."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                to = io.BytesIO()
                shape = (r.height, r.width)
                np.savez_compressed(to, frame=np.frombuffer(r.pixels, np.uint8).reshape(*shape, r.channels), mask=np.frombuffer(r.mask, np.uint8).reshape(shape))
                out.append((f"{r.video}/{r.frame}.npz", to.getvalue()))
            yield pd.DataFrame(out, columns=["name", "content"])

    rows = labels.select("video", "frame", "height", "width", "channels", "pixels", "mask")
    write_blobs(rows.mapInPandas(pack, "name string, content binary"), path)


def write_palette_masks(masks: DataFrame, path: str, palette: np.ndarray, ids: DataFrame | None = None) -> None:
    """Masks (video, frame, height, width, mask) as indexed images <video>/<frame>.png; ids (video, local, object) restores the numbers that
    objects had before they were numbered within a video."""
    from . import palette_png

    rows = masks.select("video", "frame", "height", "width", "mask", F.lit(None).cast("map<int,int>").alias("own"))
    if ids is not None:
        maps = ids.groupBy("video").agg(F.map_from_entries(F.collect_list(F.struct(F.col("local").cast("int"), F.col("object").cast("int")))).alias("own"))
        rows = rows.drop("own").join(maps, "video", "left").select("video", "frame", "height", "width", "mask", "own")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                names = np.arange(256, dtype=np.uint8)
                for local, own in dict(r.own or {}).items():
                    names[local] = own
                out.append((f"{r.video}/{r.frame:05d}.png", palette_png(names[np.frombuffer(r.mask, np.uint8)].reshape(r.height, r.width), palette)))
            yield pd.DataFrame(out, columns=["name", "content"])

    write_blobs(rows.mapInPandas(pack, "name string, content binary"), path)
