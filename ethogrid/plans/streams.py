"""Queries on streams: events arrive as files; the frame number is the event's place in its video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid import streaming

from .frames import FRAMES, RUNS
from .registry import Tables, query


def stream_of(t: Tables) -> DataFrame:
    """video, frame, label, x, y of streamed events; event_id rises with time, so it serves as the frame number."""
    t.events  # noqa: B018  makes the package known to this machine's Python workers
    events = streaming.stream_of(t.spark, f"{t.sf_dir}/events.parquet")
    return events.select(F.col("user_id").alias("video"), F.col("event_id").alias("frame"), F.col("event_type").alias("label"), F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))


@query(RUNS + """, f AS (SELECT video, frame, event_id FROM frames) SELECT r.video, r.run, r.label, a.event_id AS "start", b.event_id AS "end" FROM runs r
    JOIN f a ON a.video = r.video AND a.frame = r."start" JOIN f b ON b.video = r.video AND b.frame = r."end" WHERE r.run < (SELECT max(run) FROM runs m WHERE m.video = r.video)""")
def stream_runs(t: Tables) -> DataFrame:
    """Closed runs of a stream."""
    return streaming.drain(streaming.closed_runs(stream_of(t))).select("video", "run", "label", "start", "end")


@query(FRAMES + """SELECT video, event_id AS frame, round(CASE WHEN frame = 0 THEN 0 ELSE sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + pow(event_id % 97 - lag(event_id % 97) OVER w, 2)) END, 6) AS speed
    FROM frames WINDOW w AS (PARTITION BY video ORDER BY frame)""")
def stream_kinematics(t: Tables) -> DataFrame:
    """Speeds of a stream."""
    return streaming.drain(streaming.speeds(stream_of(t))).select("video", "frame", F.round("speed", 6).alias("speed"))


@query("""WITH e AS (SELECT user_id AS video, event_id AS frame, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id % 5 = 0),
    l AS (SELECT user_id AS video, max(event_id) AS seen FROM events GROUP BY 1)
    SELECT l.video, seen, coalesce(string_agg(CAST(frame AS VARCHAR), ',' ORDER BY frame DESC) FILTER (k <= 6), '') AS kept FROM l LEFT JOIN e USING (video) GROUP BY l.video, seen""")
def stream_memory(t: Tables) -> DataFrame:
    """The bounded memory after all frames."""
    rows = streaming.drain(streaming.memory(stream_of(t), 5, 6))
    return rows.groupBy("video").agg(F.max("seen").alias("seen"), F.max_by("kept", "seen").alias("kept")).select("video", "seen", F.array_join("kept", ",").alias("kept"))


@query("""WITH w AS (SELECT date_trunc('hour', ts) AS "begin", event_type AS kind, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
    SELECT CAST(epoch("begin") AS BIGINT) AS "begin", kind, n, total FROM w WHERE "begin" + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_window_counts(t: Tables) -> DataFrame:
    """Hourly counts of closed windows."""
    rows = streaming.drain(streaming.window_counts(streaming.stream_of(t.spark, f"{t.sf_dir}/events.parquet")))
    return rows.select(F.unix_timestamp("begin").alias("begin"), "kind", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_once(t: Tables) -> DataFrame:
    """A stream without repeated events."""
    return streaming.drain(streaming.once(streaming.stream_of(t.spark, f"{t.sf_dir}/events.parquet"))).select("event_id", "user_id", "event_type")
