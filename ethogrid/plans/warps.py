"""Queries on warped images: a mask's labels stand for the image's values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid import functions as E
from ethogrid.operators import masks, warps

from .masks import HEIGHT, PIXELS, WIDTH, pixels_of, runs_of
from .pixels import CHAIN
from .registry import Tables, query
from .training import seeded

CY, CX = HEIGHT // 2, WIDTH // 2
LEVEL = "roi * 80 + (x + y) % 7"
TARGETS = f""", img AS MATERIALIZED (SELECT frame, y, x, roi, {LEVEL} AS value FROM px), shot AS (SELECT DISTINCT frame FROM px),
    ys AS (SELECT unnest(range(0, {HEIGHT})) AS y), xs AS (SELECT unnest(range(0, {WIDTH})) AS x)
"""


def _turned(degrees: str, dx: str = "0.0", dy: str = "0.0") -> str:
    return f"""cos(radians({degrees})) * (x - {CX}) - sin(radians({degrees})) * (y - {CY}) + {CX} - {dx} AS u, sin(radians({degrees})) * (x - {CX}) + cos(radians({degrees})) * (y - {CY}) + {CY} - {dy} AS v"""


def _smooth(places: str, keys: str = "p.frame") -> str:
    """SQL of rows whose value is that of the four pixels around (v, u)."""
    return f"""SELECT {keys}, p.y, p.x, coalesce(sum((CASE WHEN i = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) * (CASE WHEN j = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * img.value), 0) AS value
        FROM {places} p, (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j) LEFT JOIN img ON img.frame = p.frame AND img.y = CAST(floor(v) AS BIGINT) + i AND img.x = CAST(floor(u) AS BIGINT) + j GROUP BY ALL"""


def images_of(t: Tables) -> DataFrame:
    return pixels_of(t).withColumn("value", (F.col("roi") * 80 + (F.col("x") + F.col("y")) % 7).cast("double"))


def _rows(values: DataFrame) -> DataFrame:
    """frame, y, total of each line that isn't blank."""
    return values.groupBy("frame", "y").agg(F.round(F.sum("value"), 4).alias("total")).where("total <> 0")


LINES = "SELECT frame, CAST(y AS BIGINT) AS y, round(sum(value), 4) AS total FROM w GROUP BY frame, y HAVING round(sum(value), 4) <> 0"


@query(PIXELS + TARGETS + f", p AS (SELECT frame, y, x, {_turned('15 + frame % 60')} FROM shot, ys, xs), w AS ({_smooth('p')}) " + LINES)
def turned_frames(t: Tables) -> DataFrame:
    """Images turned about their middle, smoothly; sums of their lines."""
    values = images_of(t)
    targets = warps.turned(warps.grid(values.select("frame").distinct(), HEIGHT, WIDTH), HEIGHT, WIDTH, 15 + F.col("frame") % 60)
    return _rows(warps.smooth(values, targets, ["frame"])).withColumn("y", F.col("y").cast("long"))


@query(CHAIN + TARGETS + f""", a AS (SELECT frame, degrees(atan2(y - {CY}, x - {CX})) - 90 AS angle FROM near WHERE roi = 2),
    p AS (SELECT frame, y, x, {_turned('angle')} FROM a, ys, xs), w AS ({_smooth('p')}) """ + LINES)  # fmt: skip
def contour_turned_frames(t: Tables) -> DataFrame:
    """Images turned so that the closest corner of the second ROI's contour lies above the middle."""
    near = masks.closest(masks.contour(runs_of(t).where("roi = 2")), CX, CY)
    angle = E.turn_angle(F.lit(CX), F.lit(CY), F.col("cx"), F.col("cy"))
    frames = near.select("frame", F.col("x").alias("cx"), F.col("y").alias("cy")).select("frame", angle.alias("angle"))
    targets = warps.turned(warps.grid(frames, HEIGHT, WIDTH), HEIGHT, WIDTH, F.col("angle"))
    return _rows(warps.smooth(images_of(t), targets, ["frame"])).withColumn("y", F.col("y").cast("long"))


@query(PIXELS + TARGETS + f""", p AS (SELECT frame, y, x, least(greatest((y + 0.5::DOUBLE) * {HEIGHT} / 48 - 0.5::DOUBLE, 0), {HEIGHT - 1}) AS v, least(greatest((x + 0.5::DOUBLE) * {WIDTH} / 25 - 0.5::DOUBLE, 0), {WIDTH - 1}) AS u
    FROM shot, (SELECT unnest(range(0, 48)) AS y), (SELECT unnest(range(0, 25)) AS x)), w AS ({_smooth('p')}) """ + LINES)  # fmt: skip
def resized_logits(t: Tables) -> DataFrame:
    """Images at another size, smoothly; sums of their lines."""
    values = images_of(t)
    targets = warps.resized(warps.grid(values.select("frame").distinct(), 48, 25), HEIGHT, WIDTH, 48, 25)
    return _rows(warps.smooth(values, targets, ["frame"])).withColumn("y", F.col("y").cast("long"))


@query(PIXELS + TARGETS + f""", k AS (SELECT frame, unnest(range(0, 4)) AS step FROM shot), c AS (SELECT frame, step, CASE WHEN step = 0 THEN 0 ELSE {seeded('frame * 97 + step + 1', 61, 31)} - 30 END AS degrees,
        CASE WHEN step = 0 THEN 0 ELSE {seeded('frame * 97 + step + 1', 11, 37)} - 5 END AS dx, CASE WHEN step = 0 THEN 0 ELSE {seeded('frame * 97 + step + 1', 11, 41)} - 5 END AS dy FROM k),
    p AS (SELECT frame, step, {_turned('degrees', 'dx', 'dy')} FROM c, ys, xs)
    SELECT p.frame, CAST(step AS INTEGER) AS step, roi, count(*) AS area FROM p JOIN img ON img.frame = p.frame AND img.y = CAST(round_even(v, 0) AS BIGINT) AND img.x = CAST(round_even(u, 0) AS BIGINT) GROUP BY ALL""")
def static_clips(t: Tables) -> DataFrame:
    """Masks as clips of four turned and shifted versions; each object's area in each."""
    labels = pixels_of(t)
    clips = warps.static_clips(labels.select("frame").distinct(), 4)
    targets = warps.turned(warps.grid(clips, HEIGHT, WIDTH), HEIGHT, WIDTH, F.col("degrees"), F.col("dx"), F.col("dy"))
    return warps.nearest(labels, targets, ["step"]).groupBy("frame", "step", "roi").agg(F.count("*").alias("area"))
