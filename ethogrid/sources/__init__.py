"""Tables from and to the files of a project.

Videos need a decoder, which is a plug-in; frames come from `.npy` stacks by a Python data source.
Masks, labels and latents are parquet tables; `.npz` files are read through Spark's binary reader, so
they may lie in any store.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethogrid import functions as E

from .files import Blobs, promoted, write_blobs, write_labels, write_palette_masks
from .stacks import FrameStacks, read_stacks, write_stacks

__all__ = ["Blobs", "FrameStacks", "promoted", "read_stacks", "write_blobs", "write_labels", "write_palette_masks", "write_stacks"]  # and the functions below
CONFIG = "project_name string, source array<string>, observer_dim int, latent map<string,string>"
LATENT_NAME = r"^(.*)_ROI_(\d+)_(rotation_)?latent\.npz$"


def projects(spark: SparkSession, path: str) -> DataFrame:
    """Project configurations; fields that a new project lacks are null. Files that don't parse give no row."""
    rows = spark.read.schema(CONFIG + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null and project_name is not null").drop("_bad")


def project_videos(configs: DataFrame) -> DataFrame:
    """project_name, video of every registered video, and 'All' first where a project has any."""
    listed = configs.select("project_name", F.explode(F.array_sort("source")).alias("video"))
    return listed.select("project_name", F.lit(1).alias("place"), "video").unionByName(listed.select("project_name").distinct().select("project_name", F.lit(0).alias("place"), F.lit("All").alias("video")))


def latent_catalog(configs: DataFrame) -> DataFrame:
    """project_name, ordinal, video, roi, kind and file of the latents a project lists, in its order."""
    rows = configs.select("project_name", F.posexplode(F.map_entries("latent")).alias("ordinal", "entry"))
    part = lambda i: F.regexp_extract("entry.key", LATENT_NAME, i)
    kind = F.when(part(3) == "", "plain").otherwise("rotation")
    return rows.select("project_name", "ordinal", F.col("entry.value").alias("video"), part(2).cast("int").alias("roi"), kind.alias("kind"), F.col("entry.key").alias("file"))


def latents_of(videos: DataFrame, files: DataFrame) -> DataFrame:
    """video, roi, kind, file: every video (with its extension) and the latent files named after it; files of another form belong to none."""
    part = lambda i: F.regexp_extract("file", LATENT_NAME, i)
    named = files.where(part(1) != "").select(part(1).alias("base"), part(2).cast("int").alias("roi"), F.when(part(3) == "", "plain").otherwise("rotation").alias("kind"), "file")
    return videos.withColumn("base", E.base_name(F.col("video"))).join(named, "base", "left").select("video", "roi", "kind", "file")


def binary_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def read_latents(spark: SparkSession, path: str) -> DataFrame:
    """video, roi, kind, frame, latent of `.npz` files; rows that hold NaN are null. Files without `latent` give no rows."""
    named = binary_files(spark, path, "*_latent.npz").withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in batch.itertuples(index=False):
                with np.load(io.BytesIO(content)) as data:
                    x = data["latent"].astype("float32") if "latent" in data.files else np.zeros((0, 0), "float32")
                for low in range(0, len(x), 1024):
                    part = x[low : low + 1024]
                    yield pd.DataFrame({"name": name, "frame": range(low, low + len(part)), "latent": [None if np.isnan(v).any() else v.tolist() for v in part]})

    rows = named.select("name", "content").mapInPandas(load, "name string, frame long, latent array<float>")
    part = lambda i: F.regexp_extract("name", LATENT_NAME, i)
    return rows.select(part(1).alias("video"), part(2).cast("int").alias("roi"), F.when(part(3) == "", "plain").otherwise("rotation").alias("kind"), "frame", "latent")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """video, frame, height, width, mask of label `.npz` files at <video>/<frame>.npz, in natural order of their keys;
    files that lack a key are skipped."""
    files = binary_files(spark, path, "*.npz").select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("video"), F.regexp_extract("path", r"(\d+)\.npz$", 1).alias("n"), "content")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for video, n, content in batch.itertuples(index=False):
                with np.load(io.BytesIO(content)) as data:
                    if {"frame", "mask"} <= set(data.files) and n:
                        mask = data["mask"].astype("uint8")
                        out.append((video, int(n), *mask.shape, mask.tobytes()))
            yield pd.DataFrame(out, columns=["video", "frame", "height", "width", "mask"])

    rows = files.mapInPandas(load, "video string, frame long, height int, width int, mask binary")
    return rows.orderBy(E.natural_key(F.col("video")), "frame")


def mask_pixels(masks: DataFrame) -> DataFrame:
    """video, frame, roi, y, x of the labelled pixels of dense masks; the background is left out."""

    def told(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        of, roi, y, x = (pa.array(np.concatenate(c)) for c in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([batch.column("video").take(of), batch.column("frame").take(of), roi, y, x], ["video", "frame", "roi", "y", "x"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for k, (h, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("height", "width")), strict=True)):
                grid = np.frombuffer(batch.column("mask")[k].as_buffer(), np.uint8).reshape(h, w)
                y, x = np.nonzero(grid)
                held.append((np.full(len(y), k), grid[y, x].astype(np.int64), y, x))
                size += len(y)
                if size >= 1 << 18:  # many small masks a batch, or one large mask
                    yield told(batch, held)
                    held, size = [], 0
            if held:
                yield told(batch, held)

    rows = masks.select("video", F.col("frame").cast("long").alias("frame"), "height", "width", "mask")
    return rows.mapInArrow(spread, "video string, frame long, roi long, y long, x long")


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Upsert by key: the row with the highest version of each key."""
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), version).alias("row")).select(*keys, "row.*")


def scalars(rows: DataFrame) -> DataFrame:
    """video, key, value: the newest scalar of each video and key. rows has version as well."""
    return newest(rows, ["video", "key"], "version")


def project_folders(spark: SparkSession, path: str) -> DataFrame:
    """project and config of every folder under the path that holds a config.json, sorted; only names are read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "config.json").option("recursiveFileLookup", True).load(path)
    return found.select(F.regexp_extract("path", r"([^/]+)/config\.json$", 1).alias("project"), F.col("path").alias("config")).orderBy("project")


def create_project(spark: SparkSession, path: str, name: str) -> str:
    """The folder of a new project, with its configuration; one that exists is refused."""
    target, files = _folder(spark, path, name)
    if files.exists(target):
        raise FileExistsError(target.toString())
    spark.createDataFrame([(json.dumps({"project_name": name}),)], "value string").coalesce(1).write.text(target.toString() + "/config.json")
    return target.toString()


def delete_project(spark: SparkSession, path: str, name: str, confirm: str) -> None:
    """Remove a project's folder; the name must be given twice, and the folder must hold a configuration."""
    target, files = _folder(spark, path, name)
    if confirm != name:
        raise ValueError("the project's name has to be confirmed")
    config = spark._jvm.org.apache.hadoop.fs.Path(target.toString() + "/config.json")
    if not files.exists(config):
        raise FileNotFoundError(config.toString())
    files.delete(target, True)


def _folder(spark: SparkSession, path: str, name: str):
    if not name or "/" in name or name in {".", ".."}:
        raise ValueError(f"not a project name: {name!r}")
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def split_names(spark: SparkSession, path: str) -> DataFrame:
    """The distinct names in a split file, one a line, without blanks around them, sorted."""
    return spark.read.text(path).select(F.trim("value").alias("sequence")).where("sequence <> ''").distinct().orderBy("sequence")


def image_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp")) -> DataFrame:
    """path, length and content of a folder's images; sub-folders are left out, and files without bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(path)
    return rows.where(E.extension(F.col("path")).isin(*extensions) & (F.col("length") > 0)).select("path", "length", "content")


def constant_frames(spark: SparkSession, sequences: int, frames: int, value: int = 0) -> DataFrame:
    """sequence, frame, value: constant frames for smoke tests."""
    rows = spark.range(sequences * frames)
    return rows.select(F.expr(f"id div {frames}").alias("sequence"), (F.col("id") % frames).alias("frame"), F.lit(value).alias("value"))


def frame_counts(frames: DataFrame) -> DataFrame:
    """video, n: one more than the last frame before the first that can't be decoded. frames has video, frame, ok."""
    bad = F.min(F.when(~F.coalesce("ok", F.lit(False)), F.col("frame")))
    return frames.groupBy("video").agg(F.coalesce(bad, F.max("frame") + 1).alias("n"))


def palette_png(mask: np.ndarray, palette: np.ndarray) -> bytes:
    """A mask of small whole numbers as a PNG of indexed colours; palette has red, green, blue of each number."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = mask.shape
    lines = np.zeros((h, w + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = mask
    head = struct.pack(">IIBBBBB", w, h, 8, 3, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"PLTE", palette.astype(np.uint8).tobytes()) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def palette_mask(png: bytes) -> np.ndarray:
    """The numbers of an indexed PNG of one to eight bits, whatever the filters of its lines."""
    at, data, shape, depth = 8, b"", (0, 0), 8
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, color, _, _, laced = struct.unpack(">IIBBBBB", body)
            if color != 3 or laced:
                raise ValueError("not an indexed image, or an interlaced one")
            shape = (h, w)
        data += body if kind == b"IDAT" else b""
        at += size + 12
    across = -(-shape[1] * depth // 8)  # bytes of a line
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[0], across + 1)
    out = np.zeros((shape[0], across), np.uint8)
    above = np.zeros(across, np.uint8)
    for k, line in enumerate(lines):
        above = out[k] = _unfiltered(int(line[0]), line[1:], above)
    if depth < 8:  # several numbers a byte, the first in its high bits
        parts = out[:, :, None] >> np.arange(8 - depth, -1, -depth, dtype=np.uint8) & ((1 << depth) - 1)
        out = parts.reshape(shape[0], -1)[:, : shape[1]]
    return out


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A line of bytes from its differences to the byte before, above, to the mean of both, or to what both foretell."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, dtype=np.uint8)
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError(f"no such filter: {kind}")
    out, left, corner = [], 0, 0
    for x, up in zip(line.tolist(), above.tolist(), strict=True):
        if kind == 3:
            guess = (left + up) // 2
        else:
            guess = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
        left, corner = (x + guess) & 255, up
        out.append(left)
    return np.array(out, np.uint8)


def without(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """Labels less those named "<frame>, <video>" in shown.name."""
    parts = F.split("name", ", ", 2)
    gone = shown.select(parts[0].cast("long").alias("frame"), parts[1].alias("video"))
    return rows.join(gone, ["video", "frame"], "left_anti")


def register(known: DataFrame, offered: DataFrame) -> DataFrame:
    """known videos and those offered whose base name isn't there; of equal names the first path."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    fresh = offered.where(E.is_video(F.col("path"))).groupBy(name.alias("video")).agg(F.min("path").alias("path"))
    return known.unionByName(fresh.join(known, "video", "left_anti"))


def write_csv(rows: DataFrame, path: str, index: str | None = None) -> None:
    """CSV with a header; `index` names a column to put first, as row number exports do."""
    columns = ([index] if index else []) + [c for c in rows.columns if c != index]
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_latents(rows: DataFrame, path: str) -> None:
    """Latents by video, roi and kind; only the partitions that are written are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video", "roi", "kind").parquet(path)


def write_srt(texts: DataFrame, path: str) -> None:
    """One text file a video: partitions by base name."""
    texts.select(E.base_name(F.col("video").cast("string")).alias("name"), F.col("text").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def write_annotations(rows: DataFrame, path: str) -> None:
    """Mask annotations as JSON lines, run lengths included."""
    rows.write.mode("overwrite").json(path)


def parse_steps(text: str) -> list[dict]:
    """A pipeline configuration: a JSON object or a list of objects; anything else raises ValueError."""
    said = json.loads(text)
    steps = said if isinstance(said, list) else [said]
    if not steps or not all(isinstance(s, dict) for s in steps):
        raise ValueError("a configuration is an object or a list of objects")
    return steps
