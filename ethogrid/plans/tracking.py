"""Queries on tracking: line items stand for frames of one pixel, and the fold over them is written out in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid import sources, streaming
from ethogrid.operators import sequences
from ethogrid.session import checkpointing
from ethogrid.streaming import clicks, tracking

from .masks import HEIGHT, WIDTH
from .registry import Tables, query

#: Small enough for all of them to matter within a few frames.
MEMORY = tracking.Memory(gap=7, blocks=5, skip=2)
END = 1 << 40
#: Frames of one pixel that make a row of the stream.
CLIP = 1_024

SHOTS = """WITH RECURSIVE shots AS (
    SELECT CAST(l_orderkey % 200 AS VARCHAR) AS video, row_number() OVER (PARTITION BY l_orderkey % 200 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS frame,
           l_partkey % 256 AS r, l_suppkey % 256 AS g, CAST(l_quantity AS BIGINT) AS b, 1 + l_suppkey % 4 AS label FROM lineitem)
"""
#: The events' fold. events has video, place, kind, frame, r, g, b, given; memories of the start are in `start` (video, kept, last).
FOLD = f""", walk AS (
    SELECT video, -1::BIGINT AS place, -1::BIGINT AS frame, 'none' AS kind, kept, last, 0::BIGINT AS step, 0::BIGINT AS noted, coalesce(last[1].l, 0) AS objects, 0::BIGINT AS found FROM start
    UNION ALL
    SELECT video, place, frame, kind,
           CASE WHEN kind = 'restart' THEN [] WHEN refers OR step - noted >= {MEMORY.gap} THEN list_prepend(own, kept)[1:{MEMORY.blocks}] ELSE kept END,
           CASE WHEN kind = 'restart' THEN [] WHEN refers THEN [own] ELSE list_append(last, own)[-{MEMORY.skip}:] END,
           CASE WHEN kind = 'restart' THEN 0 ELSE step END, CASE WHEN kind = 'restart' THEN 0 WHEN refers OR step - noted >= {MEMORY.gap} THEN step ELSE noted END,
           CASE WHEN kind = 'restart' THEN 0 WHEN refers THEN mask ELSE objects END, mask
    FROM (SELECT *, {{'r': r, 'g': g, 'b': b, 'l': mask}} AS own, kind IN ('refer', 'label') OR kind = 'grow' AND mask > objects AS refers
    FROM (SELECT *, CASE WHEN given > 0 THEN given ELSE coalesce(memories[list_position(far, list_min(far))].l, 0) END AS mask
    FROM (SELECT *, list_transform(memories, lambda m: (m.r - r) * (m.r - r) + (m.g - g) * (m.g - g) + (m.b - b) * (m.b - b)) AS far
    FROM (SELECT e.*, w.kept, w.last, w.step + CASE WHEN e.kind IN ('refer', 'restart') THEN 0 ELSE 1 END AS step, w.noted, w.objects, list_concat(w.kept, w.last[1:1]) AS memories
    FROM walk w JOIN events e ON e.video = w.video AND e.place = w.place + 1))))
)"""
EMPTY = """, start AS (SELECT DISTINCT video, CAST([] AS STRUCT(r BIGINT, g BIGINT, b BIGINT, l BIGINT)[]) AS kept, CAST([] AS STRUCT(r BIGINT, g BIGINT, b BIGINT, l BIGINT)[]) AS last FROM events)"""
LABELLED = f""", start AS (SELECT video, list({{'r': r, 'g': g, 'b': b, 'l': label}} ORDER BY frame DESC)[1:{MEMORY.blocks}] AS kept,
    list({{'r': r, 'g': g, 'b': b, 'l': label}} ORDER BY frame DESC)[1:1] AS last FROM shots WHERE frame IN (0, 10, 20) GROUP BY video)"""
TOLD = " SELECT video, frame, place, CAST(found AS BIGINT) AS found FROM walk WHERE kind IN ('track', 'label', 'grow')"


def shots_of(t: Tables) -> DataFrame:
    """video, frame, height, width, channels, pixels, mask of frames of one pixel, numbered once and kept as a table, as each query reads them several times."""
    rows = t.lineitem.select(
        (F.col("l_orderkey") % 200).cast("string").alias("video"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"),
        (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("after"),
        F.lit(1).alias("height"),
        F.lit(1).alias("width"),
        F.lit(3).alias("channels"),
        F.unhex(F.lpad(F.hex((F.col("l_partkey") % 256 * 256 + F.col("l_suppkey") % 256) * 256 + F.col("l_quantity").cast("long")), 6, "0")).alias("pixels"),
        F.unhex(F.lpad(F.hex(1 + F.col("l_suppkey") % 4), 2, "0")).alias("mask"),
    )
    frames = tracking.numbered(rows, 1 << 16).withColumnRenamed("place", "frame")
    path = f"{checkpointing(t.spark).sparkContext._jsc.sc().getCheckpointDir().get()}/shots-{uuid.uuid4().hex}"
    frames.write.parquet(path)
    return t.spark.read.schema(frames.schema).parquet(path)


def told(events: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    found = streaming.drain(tracking.track(tracking.streamed(events, clip=CLIP), "nearest_colour", MEMORY, labels))
    return found.select("video", "frame", "place", F.conv(F.hex("mask"), 16, 10).cast("long").alias("found"))


@query(SHOTS + ", events AS (SELECT video, frame AS place, 'track' AS kind, frame, r, g, b, 0::BIGINT AS given FROM shots)" + LABELLED + FOLD + TOLD)
def track_forward(t: Tables) -> DataFrame:
    """Masks of all frames, in order, by references that are known before the first."""
    shots = shots_of(t)
    return told(tracking.scheduled(shots, 0, END), shots.where("frame in (0, 10, 20)"))


@query(SHOTS + ", events AS (SELECT video, max(frame) OVER (PARTITION BY video) - frame AS place, 'track' AS kind, frame, r, g, b, 0::BIGINT AS given FROM shots)" + LABELLED + FOLD + TOLD)
def track_backward(t: Tables) -> DataFrame:
    """The same from the last frame to the first."""
    shots = shots_of(t)
    return told(tracking.scheduled(shots, END, 0), shots.where("frame in (0, 10, 20)"))


STEPS = """, each AS (SELECT *, unnest(CASE WHEN frame = 0 THEN ['refer'] WHEN frame % 50 = 49 THEN ['track', 'restart', 'refer'] ELSE ['track'] END) AS kind FROM shots),
    events AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY frame, CASE kind WHEN 'track' THEN 0 WHEN 'restart' THEN 1 ELSE 2 END) - 1 AS place, kind, frame, r, g, b,
    CASE WHEN kind = 'refer' THEN label ELSE 0 END AS given FROM each)"""


@query(SHOTS + STEPS + EMPTY + FOLD + TOLD)
def track_restarted(t: Tables) -> DataFrame:
    """A fold that forgets everything after every fiftieth frame, which becomes its new reference."""
    kinds = F.when(F.col("frame") == 0, F.array(F.lit("refer"))).when(F.col("frame") % 50 == 49, F.array(*map(F.lit, ("track", "restart", "refer")))).otherwise(F.array(F.lit("track")))
    rows = shots_of(t).select("*", F.posexplode(kinds).alias("after", "kind")).withColumn("at", F.col("frame"))
    return told(tracking.numbered(rows))


SEEN = """, objects AS (SELECT video AS sequence, frame, r % 12 AS object FROM shots), firsts AS (SELECT sequence, object, min(frame) AS frame FROM objects WHERE object <> 0 GROUP BY ALL),
    marks AS (SELECT sequence, frame, list(object ORDER BY object) AS fresh, max(object) AS top FROM firsts GROUP BY ALL),
    refs AS (SELECT sequence, frame, fresh, top, CAST(sum(len(fresh)) OVER (PARTITION BY sequence ORDER BY frame) AS BIGINT) AS objects FROM marks)
"""


def seen_of(shots: DataFrame) -> DataFrame:
    return shots.select(F.col("video").alias("sequence"), "frame", (F.conv(F.hex(F.substring("pixels", 1, 1)), 16, 10).cast("long") % 12).alias("object"))


@query(SHOTS + SEEN + "SELECT o.sequence, o.frame, r.frame AS reference, r.objects FROM objects o ASOF LEFT JOIN refs r ON o.sequence = r.sequence AND o.frame >= r.frame")
def reference_as_of(t: Tables) -> DataFrame:
    """The last reference at or before each frame, and how many objects had been seen by it."""
    seen = seen_of(shots_of(t))
    return sequences.as_of(seen.select("sequence", "frame"), sequences.reference_frames(seen), 64)


def _labelled(t: Tables, kind: str) -> DataFrame:
    """Events in which a frame that shows an object for the first time bears it as its label."""
    shots = shots_of(t)
    marks = sequences.reference_frames(seen_of(shots)).select(F.col("sequence").alias("video"), "frame", F.array_max("fresh").alias("top"))
    rows = shots.drop("mask").join(marks, ["video", "frame"], "left")
    kinds = F.when(F.col("frame") == 0, "refer").when(F.col("top").isNotNull(), kind).otherwise("track")
    mask = F.unhex(F.lpad(F.hex(F.coalesce("top", F.lit(0))), 2, "0"))
    return rows.select("video", "frame", F.col("frame").alias("at"), F.lit(0).alias("after"), kinds.alias("kind"), "height", "width", "channels", "pixels", mask.alias("mask"))


def _labelled_sql(kind: str) -> str:
    return SHOTS + SEEN + f""", events AS (SELECT s.video, s.frame AS place, CASE WHEN s.frame = 0 THEN 'refer' WHEN top IS NOT NULL THEN '{kind}' ELSE 'track' END AS kind, s.frame, s.r, s.g, s.b,
        CAST(coalesce(top, 0) AS BIGINT) AS given FROM shots s LEFT JOIN refs ON refs.sequence = s.video AND refs.frame = s.frame)""" + EMPTY + FOLD + TOLD  # fmt: skip


@query(_labelled_sql("label"))
def track_new_objects(t: Tables) -> DataFrame:
    """The evaluator's fold: a frame that shows a new object is tracked, takes its label, and becomes a reference."""
    return told(tracking.numbered(_labelled(t, "label")))


@query(_labelled_sql("grow"))
def track_incremental(t: Tables) -> DataFrame:
    """The same, but a frame becomes a reference only if it shows more objects than are known."""
    return told(tracking.numbered(_labelled(t, "grow")))


@query(f"""WITH e AS (SELECT l_orderkey // 50 AS session, row_number() OVER w - 1 AS place, CASE WHEN l_linenumber = 7 THEN 'next' WHEN l_returnflag = 'R' THEN 'remove' ELSE 'add' END AS kind,
        l_partkey % 48 AS cx, l_suppkey % 32 AS cy, count(*) FILTER (l_linenumber = 7) OVER w AS part FROM lineitem WINDOW w AS (PARTITION BY l_orderkey // 50 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)),
    c AS (SELECT *, dense_rank() OVER (PARTITION BY session ORDER BY part) AS roi FROM e WHERE kind <> 'next'),
    px AS (SELECT DISTINCT session, roi, kind, unnest(range(cy - 2, cy + 3)) AS y, cx FROM c), all_ AS (SELECT DISTINCT session, roi, kind, y, unnest(range(cx - 2, cx + 3)) AS x FROM px),
    kept AS (SELECT session, roi, y, x FROM all_ WHERE y BETWEEN 0 AND {HEIGHT - 1} AND x BETWEEN 0 AND {WIDTH - 1} GROUP BY ALL HAVING bool_and(kind = 'add'))
    SELECT CAST(session AS VARCHAR) AS frame, CAST(max(roi) AS BIGINT) AS roi, y, x FROM kept GROUP BY session, y, x""")
def click_session(t: Tables) -> DataFrame:
    """The ROIs of sessions of clicks: each from all its clicks, later ones over earlier ones."""
    rows = t.lineitem.select(
        F.expr("l_orderkey div 50").cast("string").alias("video"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"),
        (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("after"),
        F.when(F.col("l_linenumber") == 7, "next").when(F.col("l_returnflag") == "R", "remove").otherwise("add").alias("kind"),
        (F.col("l_partkey") % 48).cast("int").alias("x"),
        (F.col("l_suppkey") % 32).cast("int").alias("y"),
    )
    events = tracking.streamed(tracking.numbered(rows, 1 << 16).withColumnRenamed("video", "session"), clip=CLIP)
    masks = streaming.drain(clicks.click_masks(events, "boxes", HEIGHT, WIDTH, latest=True))
    last = masks.groupBy("session").agg(F.max_by("mask", "place").alias("mask"))
    dense = last.select(F.col("session").alias("video"), F.lit(0).cast("long").alias("frame"), F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), "mask")
    return sources.mask_pixels(dense).select(F.col("video").alias("frame"), "roi", "y", "x")
