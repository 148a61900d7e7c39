"""Objects over the frames of a sequence, and deterministic sampling of clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethogrid import functions as E


def cumulative_objects(seen: DataFrame) -> DataFrame:
    """sequence, frame, known: how many objects were seen before each frame; the first frame takes the next one's count.

    seen has sequence, frame, object. A sequence of one frame knows its own objects.
    """
    firsts = seen.groupBy("sequence", "object").agg(F.min("frame").alias("frame")).groupBy("sequence", "frame").agg(F.count("*").alias("new"))
    order = Window.partitionBy("sequence").orderBy("frame")
    frames = seen.select("sequence", "frame").distinct().join(firsts, ["sequence", "frame"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    before = F.coalesce(F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return frames.select("sequence", "frame", F.when(F.row_number().over(order) == 1, F.col("new")).otherwise(before).cast("long").alias("known"))


def contained(objects: Column, reference: Column) -> Column:
    """Whether every object but 0 is in the reference."""
    return F.size(F.array_except(F.array_remove(objects, 0), reference)) == 0


def relabelled(rows: DataFrame, group: str, label: str) -> DataFrame:
    """rows with `local`: the group's distinct labels numbered from 1; 0 stays 0."""
    numbered = rows.where(F.col(label) != 0).select(group, label).distinct().withColumn("local", F.row_number().over(Window.partitionBy(group).orderBy(label)))
    return rows.join(numbered, [group, label], "left").withColumn("local", F.coalesce("local", F.lit(0)))


def clip_indices(sequences: DataFrame, length: int, most_gap: int) -> DataFrame:
    """sequence, step, index: a clip of `length` frames after a previous one; gaps and start come from hashed keys.

    sequences has sequence and n_frames. Steps are 0 (the previous frame) to length; indices past the
    end are mirrored.
    """
    gap = lambda k: E.seeded(F.col("sequence") + 1, most_gap, k) + 1
    gaps = F.array(*[gap(k) for k in range(1, length + 1)])
    with_gaps = sequences.select("sequence", "n_frames", gaps.alias("gaps"))
    room = F.col("n_frames") - F.aggregate("gaps", F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.when(room > 0, E.seeded(F.col("sequence") + 1, F.greatest(room, F.lit(1)), 99)).otherwise(0)
    rows = with_gaps.select("sequence", "n_frames", "gaps", start.alias("start")).select("*", F.explode(F.sequence(F.lit(0), F.lit(length))).alias("step"))
    total = F.aggregate(F.slice("gaps", F.lit(1), F.col("step")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("sequence", "step", E.reflected(F.col("start") + total, F.col("n_frames")).cast("long").alias("index"))


def trainable(seen: DataFrame) -> DataFrame:
    """sequence, objects, images of sequences that can train: objects with two frames or more, and two images at least."""
    objects = seen.groupBy("sequence", "object").agg(F.countDistinct("frame").alias("n")).where("n >= 2").select("sequence", "object")
    left = seen.join(objects, ["sequence", "object"])
    return left.groupBy("sequence").agg(F.countDistinct("object").alias("objects"), F.countDistinct("frame").alias("images")).where("images >= 2")


def dense_span(seen: DataFrame, frames: DataFrame) -> DataFrame:
    """The rows of frames between a sequence's first and last labelled frame, both included."""
    span = seen.groupBy("sequence").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    return frames.join(span, "sequence").where((F.col("frame") >= F.col("first")) & (F.col("frame") <= F.col("last"))).drop("first", "last")


def reversed_half(frames: DataFrame) -> DataFrame:
    """frames (sequence, frame) with `place`: their order, turned round for the half of the sequences that a hash picks."""
    last = F.max("frame").over(Window.partitionBy("sequence"))
    turned = E.seeded(F.col("sequence") + 1, 2, 7) == 1
    return frames.select("*", turned.alias("reversed"), F.when(turned, last - F.col("frame")).otherwise(F.col("frame")).alias("place"))


def reference_frame(frames: DataFrame, least: int) -> DataFrame:
    """sequence, frame, good: a frame with more than `least` foreground pixels that a hash picks; where none has, the one
    that would be tried last. frames has sequence, frame, pixels."""
    key = E.seeded(F.col("sequence") * 1_009 + F.col("frame") + 1, 1 << 30, 3)
    good = F.col("pixels") > least
    best = F.min_by(F.struct("frame", good.alias("good")), F.struct(~good, F.when(good, key).otherwise(-key), "frame"))
    return frames.groupBy("sequence").agg(best.alias("at")).select("sequence", "at.frame", "at.good")


def repeated(sequences: DataFrame, times: int) -> DataFrame:
    """sequences with `item`: each stands `times` times, at item numbers that agree modulo their number. sequences has number."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))  # the catalogue of sequences, not their frames
    return sequences.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("turn")).withColumn("item", F.col("turn") * F.col("n") + F.col("number")).drop("n")


def by_step(frames: DataFrame, batch: int) -> DataFrame:
    """step, sample and frame of frames stacked step by step: `frame` counts batch samples of the first step, then the next."""
    return frames.select("frame", F.floor(F.col("frame") / batch).alias("step"), (F.col("frame") % batch).alias("sample"))


def with_truth(predicted: DataFrame, percent: int = 20) -> DataFrame:
    """predicted (sample, label, truth) with `used`: the truth for the share of samples that a hash picks."""
    return predicted.withColumn("used", F.when(E.seeded(F.col("sample") + 1, 100, 5) < percent, F.col("truth")).otherwise(F.col("label")))


def some_objects(objects: DataFrame, most: int) -> DataFrame:
    """At most `most` objects of each sequence, those whose hash with the sequence's number comes first."""
    order = Window.partitionBy("sequence").orderBy(E.seeded(F.col("sequence") * 1_009 + F.col("object") + 1, 1 << 30, 9), "object")
    return objects.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def sparse_frames(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequence, frame of every frame that shows an object; sequence, frame of the first ones, which have labels).
    objects has sequence, object and frames, an array."""
    shown = objects.select("sequence", F.explode("frames").alias("frame")).distinct()
    return shown, objects.select("sequence", F.array_min("frames").alias("frame")).where("frame is not null").distinct()


def reference_frames(seen: DataFrame) -> DataFrame:
    """sequence, frame, fresh, objects: the frames that show an object for the first time, these objects, and how many the
    sequence has shown so far. seen has sequence, frame, object; object 0 is the background."""
    firsts = seen.where("object <> 0").groupBy("sequence", "object").agg(F.min("frame").alias("frame"))  # a row an object from here on
    frames = firsts.groupBy("sequence", "frame").agg(F.array_sort(F.collect_list("object")).alias("fresh"))
    so_far = Window.partitionBy("sequence").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frames.select("sequence", "frame", "fresh", F.sum(F.size("fresh")).over(so_far).alias("objects"))


def as_of(frames: DataFrame, references: DataFrame, block: int = 4096) -> DataFrame:
    """frames with `reference` and `objects` of the last reference at or before each, null where none is.

    frames has sequence and frame (once each); references sequence, frame, objects. The last reference is sought within
    blocks of frames; the one that a block begins with comes from the references alone, so a long sequence isn't one task's.
    """
    part = lambda c: F.floor(F.col(c) / block)
    known = references.select("sequence", F.col("frame").alias("at"), "objects", part("frame").alias("block"))
    marked = frames.withColumn("block", part("frame")).join(known.withColumnRenamed("at", "frame"), ["sequence", "block", "frame"], "full")
    given = F.when(F.col("objects").isNotNull(), F.struct(F.col("frame").alias("reference"), "objects"))
    inside = Window.partitionBy("sequence", "block").orderBy("frame")
    marked = marked.withColumn("own", F.last(given, True).over(inside))
    ends = known.groupBy("sequence", "block").agg(F.max(F.struct(F.col("at").alias("reference"), "objects")).alias("end"))
    every = frames.select("sequence", part("frame").alias("block")).distinct().join(ends, ["sequence", "block"], "full")
    before = Window.partitionBy("sequence").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("before", F.last("end", True).over(before)).select("sequence", "block", "before")
    found = marked.join(carried, ["sequence", "block"], "left").withColumn("found", F.coalesce("own", "before"))
    asked = frames.select(*[F.col(c) for c in ("sequence", "frame")])
    return asked.join(found.select("sequence", "frame", F.col("found.reference").alias("reference"), F.col("found.objects").alias("objects")), ["sequence", "frame"])


def drawn_references(asked: DataFrame, frames: DataFrame, least: int, tries: int = 20, parts: int | None = None) -> DataFrame:
    """asked with `frame`: of up to `tries` drawn frames of a sequence, the first that shows more than `least` pixels, else the last.

    asked has sequence, draw and room (frames to draw from; the first frame where that is 1 or less); frames has sequence, frame, pixels.
    Drawn frames meet only those that show enough, in `parts` partitions if given; the turn that is found tells the frame by its hash.
    """
    keys = ["sequence", "draw"]
    asked = asked.groupBy(*keys).agg(F.max("room").alias("room"))
    drawn = lambda turn: E.seeded(F.col("sequence") * 7_919 + F.col("draw") * 101 + turn + 1, F.greatest("room", F.lit(1)), 11).cast("long")
    turns = asked.select(*keys, "room", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("turn")).select(*keys, "turn", drawn(F.col("turn")).alias("frame"))
    good = frames.where(F.col("pixels") > least).select("sequence", "frame")
    if parts:
        turns, good = (x.repartition(parts, "sequence", "frame") for x in (turns, good))
    found = turns.join(good, ["sequence", "frame"], "left_semi").groupBy(*keys).agg(F.min("turn").alias("turn"))
    return asked.join(found, keys, "left").select(*keys, drawn(F.coalesce("turn", F.lit(tries - 1))).alias("frame"))


def assembled(sequences: DataFrame, frames: DataFrame, seen: DataFrame, length: int, most_gap: int, least: int, tries: int = 5, parts: int | None = None) -> DataFrame:
    """sequence, turn, reference, clip, obj_num, complete: a clip and its reference frame, drawn until the reference shows all of the
    clip's objects, `tries` times at most; else the last draw, with complete false.

    A draw has a clip of `length` frames after a previous one (clip_indices) and a reference, which is drawn again, up to `tries` times,
    while it lies within the clip. obj_num is the highest object of the reference (0 without any). sequences has sequence
    and n_frames; frames sequence, frame, pixels; seen sequence, frame, object. With `parts`, what is as large as the frames meets
    in so many partitions, so that one holds as much whatever the size of the tables.
    """
    turns = sequences.select("sequence", "n_frames", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("turn"))
    clips = clip_indices(turns.select((F.col("sequence") * 64 + F.col("turn")).alias("sequence"), "n_frames"), length, most_gap)
    clips = clips.select(F.floor(F.col("sequence") / 64).alias("sequence"), (F.col("sequence") % 64).cast("int").alias("turn"), "step", "index")
    spans = clips.groupBy("sequence", "turn").agg(
        F.array_sort(F.collect_list(F.struct("step", "index")))["index"].alias("clip"), F.max(F.when(F.col("step") == 0, F.col("index"))).alias("begin"), F.max(F.when(F.col("step") > 0, F.col("index"))).alias("end")
    )
    again = turns.select("sequence", "turn", F.col("n_frames").alias("room"), F.explode(F.sequence(F.lit(0), F.lit(tries))).alias("again"))
    drawn = drawn_references(again.select("sequence", (F.col("turn") * 64 + F.col("again")).alias("draw"), "room"), frames, least, parts=parts)
    drawn = drawn.select("sequence", F.expr("draw div 64").cast("int").alias("turn"), (F.col("draw") % 64).alias("again"), F.col("frame").alias("reference"))
    inside = (F.col("reference") > F.col("begin")) & (F.col("reference") <= F.col("end"))
    order = F.struct(inside, F.when(inside, -F.col("again")).otherwise(F.col("again")))
    chosen = drawn.join(spans, ["sequence", "turn"]).groupBy("sequence", "turn", "clip").agg(F.min_by("reference", order).alias("reference"))
    in_clip = clips.select("sequence", "turn", F.col("index").alias("frame"))
    needed = in_clip.select("sequence", "frame").union(chosen.select("sequence", "reference")).distinct()
    some = seen.where("object <> 0")
    if parts:
        some, needed = (x.repartition(parts, "sequence", "frame") for x in (some, needed))
    shown = some.join(needed, ["sequence", "frame"], "left_semi").groupBy("sequence", "frame").agg(F.collect_set("object").alias("objects"))
    none = F.array().cast(dict(shown.dtypes)["objects"])
    of_clip = in_clip.join(shown, ["sequence", "frame"]).groupBy("sequence", "turn").agg(F.flatten(F.collect_set("objects")).alias("all"))
    whole = chosen.join(of_clip, ["sequence", "turn"], "left").join(shown.withColumnRenamed("frame", "reference"), ["sequence", "reference"], "left")
    objects = F.coalesce("objects", none)
    judged = whole.select("sequence", "turn", "reference", "clip", F.coalesce(F.array_max(objects), F.lit(0)).alias("obj_num"), contained(F.coalesce("all", none), objects).alias("complete"))
    best = F.min_by(F.struct("turn", "reference", "clip", "obj_num", "complete"), F.struct(~F.col("complete"), F.when(F.col("complete"), F.col("turn")).otherwise(-F.col("turn"))))
    return judged.groupBy("sequence").agg(best.alias("best")).select("sequence", "best.*")
