"""Aggregates over frames, masks and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethogrid import functions as E


def meter(rows: DataFrame, value: str) -> DataFrame:
    """rows with running total, n and mean of a value, by video in frame order."""
    so_far = Window.partitionBy("video").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("*", F.sum(value).over(so_far).alias("total"), F.count(value).over(so_far).alias("n"), F.avg(value).over(so_far).alias("mean"))


def momentum_mean(rows: DataFrame, value: str, momentum: float = 0.9) -> DataFrame:
    """video, mean: a momentum average that starts as a true mean; the n-th value weighs max(1/n, 1 - momentum)."""
    ordered = F.array_sort(F.collect_list(F.struct("frame", value)))
    step = lambda s, x: F.struct(
        (s["n"] + 1).alias("n"), (s["mean"] + (x[value] - s["mean"]) * F.greatest(1.0 / (s["n"] + 1), F.lit(1 - momentum))).alias("mean")
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"))
    return rows.where(F.col(value).isNotNull()).groupBy("video").agg(F.aggregate(ordered, start, step)["mean"].alias("mean"))


def ema(rows: DataFrame, value: str, decay: float = 0.9) -> DataFrame:
    """video, ema, n: the last exponential moving average; the decay is min(decay, (1 + i) / (10 + i)) at step i.

    The fold is one pass over a video's ordered values in the JVM.
    """
    ordered = F.array_sort(F.collect_list(F.struct("frame", F.col(value).alias("v"))))

    def step(s: Column, x: Column) -> Column:
        d = F.least(F.lit(decay), (1.0 + s["i"]) / (10.0 + s["i"]))
        return F.struct((s["i"] + 1).alias("i"), F.when(s["i"] == 0, x["v"]).otherwise(s["ema"] * d + x["v"] * (1 - d)).alias("ema"))

    start = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("ema"))
    done = rows.groupBy("video").agg(F.aggregate(ordered, start, step).alias("s"))
    return done.select("video", F.col("s.ema").alias("ema"), F.col("s.i").alias("n"))


def fps(rows: DataFrame) -> DataFrame:
    """frames, all_frame_fps (total over total) and all_seq_fps (of the mean time a frame of each video)."""
    each = rows.groupBy("video").agg(F.count("*").alias("frames"), F.sum("seconds").alias("seconds"))
    return each.agg(
        F.sum("frames").alias("frames"), (F.sum("frames") / F.sum("seconds")).alias("all_frame_fps"), (1 / F.avg(F.col("seconds") / F.col("frames"))).alias("all_seq_fps")
    )


def stability(pixels: DataFrame, by: str, value: str, threshold: float, offset: float) -> DataFrame:
    """Share of the pixels above threshold - offset that are above threshold + offset too; null where there are none."""
    above = lambda t: F.count_if(F.col(value) > t)
    return pixels.groupBy(by).agg(F.try_divide(above(threshold + offset), above(threshold - offset)).alias("stability"))


def mean_iou(pred: DataFrame, truth: DataFrame, eps: float = 1e-6) -> DataFrame:
    """One row, miou: per object (i + eps) / (u + eps), mean over a sample's objects, then over samples that have objects; 1 if none has.

    pred and truth have sample, pixel and object, where background isn't listed.
    """
    t, p = truth.withColumnRenamed("object", "t"), pred.withColumnRenamed("object", "p")
    both = t.join(p, ["sample", "pixel"], "full")
    listed = both.select("sample", F.explode(F.array_distinct(F.array_compact(F.array("t", "p")))).alias("object"), (F.col("t") == F.col("p")).alias("same"), F.col("t"))
    each = listed.groupBy("sample", "object").agg(F.count_if("same").alias("i"), F.count("*").alias("u"), F.count_if(F.col("t") == F.col("object")).alias("in_truth"))
    scored = each.where("in_truth > 0").select("sample", ((F.col("i") + eps) / (F.col("u") + eps)).alias("iou"))
    return scored.groupBy("sample").agg(F.avg("iou").alias("iou")).agg(F.coalesce(F.avg("iou"), F.lit(1.0)).alias("miou"))


def overlap_losses(rows: DataFrame, alpha: float, beta: float, ignore: int = 255) -> DataFrame:
    """object, dice, tversky and jaccard losses; rows has object, truth (0 or 1) and score; truth = ignore is left out."""
    kept = rows.where(F.col("truth") != ignore)
    tp, fp, fn = F.sum(F.col("score") * F.col("truth")), F.sum(F.col("score") * (1 - F.col("truth"))), F.sum((1 - F.col("score")) * F.col("truth"))
    sums = kept.groupBy("object").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.sum("score").alias("s"), F.sum("truth").alias("t")).where("t > 0")
    ratio = lambda a, b: 1 - (F.col("tp") + 1e-6) / (F.col("tp") + a * F.col("fp") + b * F.col("fn") + 1e-6)
    return sums.select("object", (1 - (2 * F.col("tp") + 1) / (F.col("s") + F.col("t") + 1)).alias("dice"), ratio(alpha, beta).alias("tversky"), ratio(1, 1).alias("jaccard"))


def top_share_mean(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """Mean of the largest `share` of each group's values (at least one)."""
    w = Window.partitionBy(by)
    ranked = rows.select(by, value, F.row_number().over(w.orderBy(F.desc(value))).alias("place"), F.count("*").over(w).alias("n"))
    return ranked.where(F.col("place") <= F.greatest(F.floor(F.col("n") * share), F.lit(1))).groupBy(by).agg(F.avg(value).alias("mean"), F.count("*").alias("k"))


def mean_probability_class(rows: DataFrame, by: str) -> DataFrame:
    """The class with the highest mean probability; the lowest class wins ties."""
    means = rows.groupBy(by, "class").agg(F.avg("probability").alias("probability"))
    return means.groupBy(by).agg(F.max_by(F.struct("class", "probability"), F.struct("probability", -F.col("class"))).alias("top")).select(by, F.col("top.class").alias("class"), F.col("top.probability").alias("probability"))


def merge_engines(rows: DataFrame, by: str) -> DataFrame:
    """Background over engines: the least logit, and the logit of the product of their probabilities."""
    p = E.sigmoid(F.col("logit"))
    product = F.exp(F.sum(F.ln(F.least(F.greatest(p, F.lit(1e-5)), F.lit(1 - 1e-5)))))
    return rows.groupBy(by).agg(F.min("logit").alias("least"), E.logit(product).alias("merged"))
