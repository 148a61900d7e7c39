"""Positions over time: dense frame ranges, speed, and the wide table that is exported."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense(videos: DataFrame, rows: DataFrame, on: str = "frame") -> DataFrame:
    """Every frame 0 .. total_frames - 1 of each video, with what rows hold for it; missing frames are null."""
    frames = videos.where("total_frames > 0").select("video", F.explode(F.expr("sequence(0L, total_frames - 1)")).alias(on))
    return frames.join(rows, ["video", on], "left")


def speed(points: DataFrame, *by: str) -> DataFrame:
    """points with `speed`: the distance to the previous frame; 0 for the first, null where an end is missing."""
    order = Window.partitionBy("video", *by).orderBy("frame")
    dx, dy = F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)
    return points.withColumn("speed", F.when(F.row_number().over(order) == 1, F.lit(0.0)).otherwise(F.sqrt(dx * dx + dy * dy)))


def wide(points: DataFrame, rois: list[int]) -> DataFrame:
    """One row a frame with x, y, speed and area of every ROI; the ROI list is given, so no pass collects it."""
    picked = points.groupBy("video", "frame").pivot("roi", rois).agg(F.first("x").alias("x"), F.first("y").alias("y"), F.first("speed").alias("speed"), F.first("area").alias("area"))
    return picked.select("video", "frame", *[F.col(f"{r}_{c}").alias(f"roi{r}_{c}") for r in rois for c in ("x", "y", "speed", "area")])


def areas(pixels: DataFrame) -> DataFrame:
    """Area and centroid (rounded half to even) of each ROI in each frame."""
    rounded = lambda c: F.bround(F.avg(c)).cast("long")
    return pixels.groupBy("frame", "roi").agg(F.count("*").alias("area"), rounded("x").alias("x"), rounded("y").alias("y"))
