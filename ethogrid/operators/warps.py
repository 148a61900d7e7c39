"""Warps as joins: every target pixel knows the place in the source that it comes from, and meets the pixels there.

Targets are rows (frame, y, x, v, u) with the source's row v and column u; sources are rows (frame, y, x, value). The
work is a shuffled join by frame and pixel, so an image of any size is shared among tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethogrid import functions as E


def grid(frames: DataFrame, height: int, width: int) -> DataFrame:
    """frames with y and x of every pixel of an image."""
    rows = frames.select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))


def turned(targets: DataFrame, height: int, width: int, degrees: Column, dx: Column | float = 0.0, dy: Column | float = 0.0) -> DataFrame:
    """targets with v and u: the image turned about its middle after a shift."""
    dx, dy = (c if isinstance(c, Column) else F.lit(c) for c in (dx, dy))
    angle, y, x = F.radians(degrees), F.col("y") - height // 2, F.col("x") - width // 2
    u = F.cos(angle) * x - F.sin(angle) * y + width // 2 - dx
    v = F.sin(angle) * x + F.cos(angle) * y + height // 2 - dy
    return targets.withColumns({"v": v, "u": u})


def resized(targets: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """targets (of the new size) with v and u in the old one: centres of pixels meet, and the border's values go on outside."""
    place = lambda c, old, new: F.least(F.greatest((F.col(c) + 0.5) * old / new - 0.5, F.lit(0.0)), F.lit(old - 1.0))
    return targets.withColumns({"v": place("y", height, new_height), "u": place("x", width, new_width)})


def smooth(values: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, value: the four pixels around each target's source, weighted by nearness; pixels that aren't there are 0."""
    own = [*dict.fromkeys(["frame", *keys, "y", "x"])]
    v0, u0 = F.floor("v"), F.floor("u")
    corners = F.array(*[
        F.struct((v0 + i).alias("sy"), (u0 + j).alias("sx"), ((F.col("v") - v0 if i else 1 - (F.col("v") - v0)) * (F.col("u") - u0 if j else 1 - (F.col("u") - u0))).alias("share"))
        for i in (0, 1)
        for j in (0, 1)
    ])
    asked = targets.select(*own, F.explode(corners).alias("at")).select(*own, "at.*")
    source = values.select("frame", F.col("y").alias("sy"), F.col("x").alias("sx"), "value")
    return asked.join(source, ["frame", "sy", "sx"], "left").groupBy(*own).agg(F.sum(F.coalesce(F.col("share") * F.col("value"), F.lit(0.0))).alias("value"))


def nearest(labels: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, roi of the targets whose source (rounded, halves to even) bears a label."""
    own = [*dict.fromkeys(["frame", *keys, "y", "x"])]
    asked = targets.select(*own, F.rint("v").cast("long").alias("sy"), F.rint("u").cast("long").alias("sx"))
    source = labels.select("frame", F.col("y").alias("sy"), F.col("x").alias("sx"), "roi")
    return asked.join(source, ["frame", "sy", "sx"]).select(*own, "roi")


def static_clips(frames: DataFrame, length: int, most_degrees: int = 30, most_shift: int = 5) -> DataFrame:
    """frame, step, degrees, dx, dy: each image as a clip of so many steps, which an arithmetic hash turns and shifts; step 0 is the
    image itself."""
    rows = frames.select("frame", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("step"))
    key = F.col("frame") * 97 + F.col("step") + 1
    drawn = lambda most, salt: F.when(F.col("step") == 0, 0).otherwise(E.seeded(key, 2 * most + 1, salt) - most)
    return rows.select("frame", "step", drawn(most_degrees, 31).alias("degrees"), drawn(most_shift, 37).alias("dx"), drawn(most_shift, 41).alias("dy"))
