"""Ordered operators over labels per frame: runs, windows, offsets, subtitles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethogrid import functions as E


def runs(frames: DataFrame) -> DataFrame:
    """video, run, label, start, end, n: maximal stretches of one label; frames has video, frame, label."""
    order = Window.partitionBy("video").orderBy("frame")
    changed = (~F.col("label").eqNullSafe(F.lag("label").over(order)) | (F.row_number().over(order) == 1)).cast("long")
    numbered = frames.select("video", "frame", "label", F.sum(changed).over(order).alias("run"))
    return numbered.groupBy("video", "run").agg(F.first("label").alias("label"), F.min("frame").alias("start"), F.max("frame").alias("end"), F.count("*").alias("n"))


def segment_widths(spans: DataFrame) -> DataFrame:
    """Runs with `width`, from one start to the next, and `shown`, one less for the last run as plots draw it."""
    order = Window.partitionBy("video").orderBy("run")
    last = F.lead("start").over(order).isNull()
    return spans.select("video", "run", "start", F.col("n").alias("width"), (F.col("n") - last.cast("long")).alias("shown"))


def windows(frames: DataFrame, width: int, vector: str = "latent") -> DataFrame:
    """video, bin, joined vector of each whole window of `width` frames; an incomplete tail is dropped."""
    binned = frames.withColumn("bin", F.expr(f"frame div {width}")).groupBy("video", "bin")
    rows = binned.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("frame", vector))).alias("parts")).where(F.col("n") == width)
    return rows.select("video", "bin", F.flatten(F.transform("parts", lambda p: p[vector])).alias(vector))


def offsets(bins: DataFrame) -> DataFrame:
    """video, ordinal, n_bins, start_bin: videos laid end to end in their order; bins has video, ordinal, n_bins."""
    before = Window.partitionBy(F.lit(0)).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return bins.select("video", "ordinal", "n_bins", F.coalesce(F.sum("n_bins").over(before), F.lit(0)).cast("long").alias("start_bin"))


def bin_to_frame(points: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """bin, video, frame: the middle frame of each global bin.

    The range join is an equality join on blocks of bins: each video is listed under the blocks it
    covers, so no side is broadcast and no pair outside a block is formed.
    """
    block = 256
    last = F.col("start_bin") + F.col("n_bins") - 1
    listed = places.where("n_bins > 0").select("*", F.explode(F.sequence(F.expr(f"start_bin div {block}"), F.floor(last / block))).alias("block"))
    near = points.withColumn("block", F.expr(f"bin div {block}")).join(listed, "block")
    inside = near.where((F.col("bin") >= F.col("start_bin")) & (F.col("bin") < F.col("start_bin") + F.col("n_bins")))
    return inside.select("bin", "video", ((F.col("bin") - F.col("start_bin")) * width + width // 2).cast("long").alias("frame"))


def upsample(bins: DataFrame, width: int) -> DataFrame:
    """video, frame, label: each bin's label once for each of its frames."""
    return bins.select("video", F.explode(F.expr(f"sequence(bin * {width}, bin * {width} + {width - 1})")).alias("frame"), "label")


def cues(spans: DataFrame, fps_num: int, fps_den: int = 1) -> DataFrame:
    """video, cue, begin, finish, label: subtitle cues of runs, numbered from 1."""
    text = lambda c: E.timestamp_text(E.frame_ms(F.col(c), fps_num, fps_den))
    return spans.select("video", F.col("run").alias("cue"), text("start").alias("begin"), text("end").alias("finish"), F.coalesce("label", F.lit("invalid")).alias("label"))


def srt(cue_rows: DataFrame) -> DataFrame:
    """video and the text of its subtitle file."""
    line = F.concat_ws("\n", F.col("cue").cast("string"), F.concat(F.col("begin"), F.lit(" --> "), F.col("finish")), F.col("label"), F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct("cue", line.alias("line"))))
    return cue_rows.groupBy("video").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
