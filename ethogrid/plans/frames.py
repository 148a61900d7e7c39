"""Queries on frames: a user's events are a video's frames, the event type is the behaviour label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethogrid import functions as E
from ethogrid.operators import kinematics, metrics, timeline

from .registry import Tables, query

FRAMES = """WITH frames AS (
    SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_type AS label,
           value AS x, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y, event_id
    FROM events)
"""
RUNS = FRAMES + """, marked AS (
    SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER w OR frame = 0 THEN 1 ELSE 0 END AS changed FROM frames WINDOW w AS (PARTITION BY video ORDER BY frame)
), numbered AS (SELECT *, sum(changed) OVER (PARTITION BY video ORDER BY frame) AS run FROM marked
), runs AS (
    SELECT video, CAST(run AS BIGINT) AS run, min(label) AS label, CAST(min(frame) AS BIGINT) AS "start", CAST(max(frame) AS BIGINT) AS "end", CAST(count(*) AS BIGINT) AS n
    FROM numbered GROUP BY video, run)
"""


def frames_of(t: Tables) -> DataFrame:
    """video, frame, label, x, y, event_id."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select(
        F.col("user_id").alias("video"), (F.row_number().over(order).cast("long") - 1).alias("frame"), F.col("event_type").alias("label"),
        F.col("value").alias("x"), F.lead("value").over(order).alias("y"), "event_id",
    )


def videos_of(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("user_id").alias("video")).agg(F.count("*").alias("total_frames"))


@query(FRAMES + "SELECT video, CAST(frame AS BIGINT) AS frame, label, event_id FROM frames WHERE frame >= 10 AND frame < 20")
def frames_scan(t: Tables) -> DataFrame:
    """Frames 10 to 19 of every video."""
    return frames_of(t).where("frame >= 10 and frame < 20").select("video", "frame", "label", "event_id")


@query("""SELECT user_id AS video, event_type AS "key", arg_max(value, event_id) AS value, max(event_id) AS version FROM events GROUP BY ALL""")
def mask_point_lookup(t: Tables) -> DataFrame:
    """Upserts by key: the last version wins."""
    return t.events.groupBy(F.col("user_id").alias("video"), F.col("event_type").alias("key")).agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("version"))


@query(FRAMES + """, v AS (SELECT video, max(frame) AS last FROM frames GROUP BY video), dense AS (SELECT video, unnest(range(0, last + 1)) AS frame FROM v)
    SELECT d.video, CAST(d.frame AS BIGINT) AS frame, f.x, CASE WHEN f.x IS NULL THEN 0 ELSE 1 END AS area
    FROM dense d LEFT JOIN (SELECT * FROM frames WHERE label = 'click') f ON d.video = f.video AND d.frame = f.frame""")  # fmt: skip
def dense_frame_left_join(t: Tables) -> DataFrame:
    """A dense frame range with the masks that exist."""
    masks = frames_of(t).where("label = 'click'").select("video", "frame", "x")
    return kinematics.dense(videos_of(t), masks).withColumn("area", F.when(F.col("x").isNull(), 0).otherwise(1))


@query(FRAMES + """SELECT video, CAST(frame AS BIGINT) AS frame, round(CASE WHEN frame = 0 THEN 0 ELSE
    sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) END, 6) AS speed FROM frames WINDOW w AS (PARTITION BY video ORDER BY frame)""")
def kinematics_speed(t: Tables) -> DataFrame:
    """Speed in pixels a frame."""
    return kinematics.speed(frames_of(t)).select("video", "frame", F.round("speed", 6).alias("speed"))


@query(FRAMES + """, p AS (SELECT video, frame // 2 AS frame, frame % 2 + 1 AS roi, x, y FROM frames),
    s AS (SELECT *, round(CASE WHEN row_number() OVER w = 1 THEN 0 ELSE sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) END, 6) AS speed
          FROM p WINDOW w AS (PARTITION BY video, roi ORDER BY frame))
    SELECT video, CAST(frame AS BIGINT) AS frame, max(x) FILTER (roi = 1) AS roi1_x, max(y) FILTER (roi = 1) AS roi1_y, max(speed) FILTER (roi = 1) AS roi1_speed,
           CAST(max(1) FILTER (roi = 1) AS INTEGER) AS roi1_area, max(x) FILTER (roi = 2) AS roi2_x, max(y) FILTER (roi = 2) AS roi2_y, max(speed) FILTER (roi = 2) AS roi2_speed,
           CAST(max(1) FILTER (roi = 2) AS INTEGER) AS roi2_area FROM s GROUP BY ALL""")  # fmt: skip
def kinematics_wide(t: Tables) -> DataFrame:
    """Alternate frames stand for two ROIs; one wide row a frame."""
    points = frames_of(t).select("video", F.expr("frame div 2").alias("frame"), (F.col("frame") % 2 + 1).alias("roi"), "x", "y").withColumn("area", F.lit(1))
    return kinematics.wide(kinematics.speed(points, "roi").withColumn("speed", F.round("speed", 6)), [1, 2])


@query(RUNS + 'SELECT video, run, label, "start", "end", n FROM runs')
def behavior_runs(t: Tables) -> DataFrame:
    """Stretches of one behaviour."""
    return timeline.runs(frames_of(t))


@query(RUNS + 'SELECT video, run, "start", n AS width, n - CASE WHEN lead("start") OVER (PARTITION BY video ORDER BY run) IS NULL THEN 1 ELSE 0 END AS shown FROM runs')
def segment_widths(t: Tables) -> DataFrame:
    """Widths of stretches, as they are and as plots draw them."""
    return timeline.segment_widths(timeline.runs(frames_of(t)))


def _stamp(c: str) -> str:
    ms = f'("{c}" * 1001000) // 30000'
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


@query(RUNS + f'SELECT video, run AS cue, {_stamp("start")} AS "begin", {_stamp("end")} AS finish, coalesce(label, \'invalid\') AS label FROM runs')
def srt_export(t: Tables) -> DataFrame:
    """Subtitle cues at 30000/1001 frames a second."""
    return timeline.cues(timeline.runs(frames_of(t)), 30_000, 1_001)


@query(RUNS + f"""SELECT video, string_agg(concat_ws(chr(10), CAST(run AS VARCHAR), {_stamp("start")} || ' --> ' || {_stamp("end")}, label, ''), chr(10) ORDER BY run) AS text FROM runs GROUP BY video""")
def srt_files(t: Tables) -> DataFrame:
    """The text of each video's subtitle file."""
    return timeline.srt(timeline.cues(timeline.runs(frames_of(t)), 30_000, 1_001))


@query(FRAMES + """, b AS (SELECT video, frame // 3 AS bin, min(label) AS label FROM frames GROUP BY ALL HAVING count(*) = 3)
    SELECT video, CAST(unnest(range(bin * 3, bin * 3 + 3)) AS BIGINT) AS frame, label FROM b""")
def bin_upsample(t: Tables) -> DataFrame:
    """A label a bin, repeated for its frames."""
    bins = frames_of(t).groupBy("video", F.expr("frame div 3").alias("bin")).agg(F.min("label").alias("label"), F.count("*").alias("n")).where("n = 3")
    return timeline.upsample(bins, 3)


OFFSETS = FRAMES + """, b AS (SELECT video, video AS ordinal, CAST(count(*) // 7 AS BIGINT) AS n_bins FROM frames GROUP BY video),
    o AS (SELECT *, CAST(coalesce(sum(n_bins) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_bin FROM b)
"""


def offsets_of(t: Tables) -> DataFrame:
    return timeline.offsets(videos_of(t).select("video", F.col("video").alias("ordinal"), F.expr("total_frames div 7").alias("n_bins")))


@query(OFFSETS + "SELECT * FROM o")
def cumulative_offsets(t: Tables) -> DataFrame:
    """Where each video's bins start when videos are laid end to end."""
    return offsets_of(t)


@query(OFFSETS + ", p AS (SELECT CAST(l_orderkey AS BIGINT) AS bin FROM lineitem GROUP BY 1) SELECT bin, video, CAST((bin - start_bin) * 7 + 3 AS BIGINT) AS frame FROM p JOIN o ON bin >= start_bin AND bin < start_bin + n_bins")
def bin_to_frame(t: Tables) -> DataFrame:
    """The video and middle frame of global bins."""
    return timeline.bin_to_frame(t.lineitem.select(F.col("l_orderkey").alias("bin")).distinct(), offsets_of(t), 7)


@query(FRAMES + """SELECT video, CAST(frame AS BIGINT) AS frame, round(sum(x) OVER w, 4) AS total, CAST(count(x) OVER w AS BIGINT) AS n, CAST(round(avg(x) OVER w * 1e6 + 1e-3) AS BIGINT) AS micro_mean
    FROM frames WINDOW w AS (PARTITION BY video ORDER BY frame ROWS UNBOUNDED PRECEDING)""")
def running_meter(t: Tables) -> DataFrame:
    """Running sum, count and mean."""
    # the values have two digits, so means often lie half way between two roundings: a small shift decides them
    micro = F.round(F.col("mean") * 1e6 + 1e-3).cast("long")
    return metrics.meter(frames_of(t), "x").select("video", "frame", F.round("total", 4).alias("total"), "n", micro.alias("micro_mean"))


@query("WITH RECURSIVE " + FRAMES[5:] + """, e AS (
    SELECT video, frame, x AS ema FROM frames WHERE frame = 0
    UNION ALL SELECT f.video, f.frame, e.ema * least(0.9, (1.0 + f.frame) / (10.0 + f.frame)) + f.x * (1 - least(0.9, (1.0 + f.frame) / (10.0 + f.frame)))
    FROM e JOIN frames f ON f.video = e.video AND f.frame = e.frame + 1)
    SELECT video, round(arg_max(ema, frame), 6) AS ema, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY video""")
def ema_fold(t: Tables) -> DataFrame:
    """The last exponential moving average of each video."""
    return metrics.ema(frames_of(t), "x").select("video", F.round("ema", 6).alias("ema"), "n")


@query(FRAMES + """, s AS (SELECT video, count(*) AS frames, sum(x) AS seconds FROM frames GROUP BY video)
    SELECT CAST(sum(frames) AS BIGINT) AS frames, round(sum(frames) / sum(seconds), 6) AS all_frame_fps, round(1 / avg(seconds / frames), 6) AS all_seq_fps FROM s""")
def fps_two_ways(t: Tables) -> DataFrame:
    """Frames a second over all frames, and by the mean of sequences."""
    out = metrics.fps(frames_of(t).select("video", F.col("x").alias("seconds")))
    return out.select("frames", F.round("all_frame_fps", 6).alias("all_frame_fps"), F.round("all_seq_fps", 6).alias("all_seq_fps"))


@query(FRAMES + """SELECT video, CAST(frame AS BIGINT) AS frame, round(CASE WHEN frame < 20 THEN 0.01 * frame / 20 ELSE greatest(0.01 * pow(1 - (frame - 20) / 180.0, 0.9), 1e-5) END, 9) AS rate FROM frames WHERE frame < 200""")
def warmup_schedule(t: Tables) -> DataFrame:
    """Warm-up and polynomial decay by step."""
    return frames_of(t).where("frame < 200").select("video", "frame", F.round(E.warmup_rate(F.col("frame"), 0.01, 20, 200), 9).alias("rate"))


@query("""WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT k, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first_id FROM k GROUP BY k""")
def config_explode(t: Tables) -> DataFrame:
    """JSON properties parsed to a map and exploded."""
    props = t.events.select("event_id", F.explode(F.from_json("props", "map<string,long>")).alias("key", "k")).where("key = 'k'")
    return props.groupBy("k").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
