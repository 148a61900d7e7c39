"""Masks of images by a function of Arrow batches: line items stand for images of 24 by 20 pixels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid.operators import generation

from .registry import Tables, query

HEIGHT, WIDTH, SIDE = 20, 24, 2
SET = generation.Settings(side=SIDE, layers=1, overlap=0.25, quality=0.3, stability=0.5, offset=4.0, suppress=70, slack=1.0)
#: Each order line of the lowest number in its order is an image; a pixel's value is a rule of place and line.
IMAGES = "SELECT l_orderkey AS image, min(l_partkey * 7 + l_suppkey) AS k FROM lineitem WHERE l_orderkey % 40 = l_suppkey % 40 GROUP BY l_orderkey"
VALUE = "(x // 6 * (17 + k % 50) + y // 5 * (29 + k % 31) + (x + 2 * y) % 3) % 256"


def _kept(source: str, group: str, order: str, name: str) -> str:
    """SQL of greedy suppression: candidates by order, each against those kept before."""
    inter = "greatest(0, least(b.x1, c.x1) - greatest(b.x0, c.x0)) * greatest(0, least(b.y1, c.y1) - greatest(b.y0, c.y0))"
    size = lambda t: f"({t}.x1 - {t}.x0) * ({t}.y1 - {t}.y0)"
    return f"""{name}_n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS place FROM {source}),
    {name}_w AS (SELECT DISTINCT {group}, 0::BIGINT AS place, CAST([] AS STRUCT(x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT)[]) AS held, false AS good FROM {name}_n
        UNION ALL SELECT {', '.join('w.' + g.strip() for g in group.split(','))}, c.place, CASE WHEN len(list_filter(w.held, lambda b: 100 * ({inter}) > {SET.suppress} * ({size('b')} + {size('c')} - ({inter})))) = 0
            THEN list_append(w.held, {{'x0': c.x0, 'y0': c.y0, 'x1': c.x1, 'y1': c.y1}}) ELSE w.held END,
            len(list_filter(w.held, lambda b: 100 * ({inter}) > {SET.suppress} * ({size('b')} + {size('c')} - ({inter})))) = 0
        FROM {name}_w w JOIN {name}_n c ON {' AND '.join(f'c.{g.strip()} = w.{g.strip()}' for g in group.split(','))} AND c.place = w.place + 1),
    {name} AS (SELECT n.* FROM {name}_n n JOIN {name}_w w USING ({group}, place) WHERE w.good)"""


def _painted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pixels of images by their numbers k."""
    x, y = np.meshgrid(np.arange(WIDTH), np.arange(HEIGHT))
    for batch in batches:
        k = batch.column("k").to_numpy().astype(np.int64)[:, None, None]
        value = (x // 6 * (17 + k % 50) + y // 5 * (29 + k % 31) + (x + 2 * y) % 3) % 256
        yield pa.RecordBatch.from_arrays([batch.column("image"), pa.array([v.tobytes() for v in value.astype(np.uint8)], pa.binary())], ["image", "pixels"])


def images_of(t: Tables) -> DataFrame:
    """image, height, width, channels, pixels."""
    images = t.lineitem.where("l_orderkey % 40 = l_suppkey % 40").groupBy(F.col("l_orderkey").alias("image")).agg(F.min(F.col("l_partkey") * 7 + F.col("l_suppkey")).alias("k"))
    painted = images.mapInArrow(_painted, "image long, pixels binary")
    return painted.select("image", F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), F.lit(1).alias("channels"), "pixels")


MORE = int(0.25 * min(HEIGHT, WIDTH) * (2.0 / 2))
CROP_W, CROP_H = -(-(MORE + WIDTH) // 2), -(-(MORE + HEIGHT) // 2)


@query(f"""WITH RECURSIVE im AS ({IMAGES}), crop AS (SELECT 0 AS layer, 0 AS cx, 0 AS cy, {WIDTH} AS ex, {HEIGHT} AS ey UNION ALL
        SELECT 1, i * ({CROP_W} - {MORE}), j * ({CROP_H} - {MORE}), least(i * ({CROP_W} - {MORE}) + {CROP_W}, {WIDTH}), least(j * ({CROP_H} - {MORE}) + {CROP_H}, {HEIGHT}) FROM (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
    ask AS (SELECT *, (point % {SIDE} + 0.5::DOUBLE) / {SIDE} * (ex - cx) AS ax, (point // {SIDE} + 0.5::DOUBLE) / {SIDE} * (ey - cy) AS ay FROM im, crop, (SELECT unnest(range(0, {SIDE * SIDE})) AS point)),
    spot AS (SELECT *, CAST(floor(ax) AS BIGINT) + cx AS x, CAST(floor(ay) AS BIGINT) + cy AS y FROM ask), seen AS (SELECT * EXCLUDE (x, y), {VALUE} AS own FROM spot),
    px AS (SELECT image, layer, cx, cy, ex, ey, point, ax, ay, x, y, abs({VALUE} - own) AS far FROM seen, (SELECT unnest(range(0, {WIDTH})) AS x), (SELECT unnest(range(0, {HEIGHT})) AS y) WHERE x >= cx AND x < ex AND y >= cy AND y < ey),
    cand AS (SELECT image, layer, cx, cy, ex, ey, point, candidate, ax + cx AS px, ay + cy AS py, avg(CASE WHEN far >= wide THEN 1 ELSE 0 END) AS quality, count(*) FILTER (wide - far > 4) / count(*) FILTER (wide - far > -4) AS stability,
        count(*) FILTER (far < wide) AS area, min(x) FILTER (far < wide) AS x0, min(y) FILTER (far < wide) AS y0, max(x) FILTER (far < wide) AS x1, max(y) FILTER (far < wide) AS y1
        FROM px, (SELECT unnest([8, 24, 72]) AS wide, unnest([0, 1, 2]) AS candidate) GROUP BY ALL),
    good AS (SELECT *, layer || '/' || cy || '/' || cx AS crop FROM cand WHERE quality > {SET.quality} AND stability >= {SET.stability} AND area > 0
        AND NOT (abs(x0 - cx) <= 1 AND NOT x0 <= 1 OR abs(y0 - cy) <= 1 AND NOT y0 <= 1 OR abs(x1 - ex) <= 1 AND NOT abs(x1 - {WIDTH}) <= 1 OR abs(y1 - ey) <= 1 AND NOT abs(y1 - {HEIGHT}) <= 1)),
    {_kept('good', 'image, crop', 'quality DESC, point, candidate', 'one')}, {_kept('(SELECT * EXCLUDE (place) FROM one)', 'image', '(ex - cx) * (ey - cy), crop, point, candidate', 'two')}
    SELECT image, crop, CAST(point AS INTEGER) AS point, candidate, round(px, 4) AS x, round(py, 4) AS y, round(quality, 6) AS quality, round(stability, 6) AS stability, CAST(area AS BIGINT) AS area, x0 AS "left", y0 AS top, x1 AS "right", y1 AS bottom FROM two""")
def generated_masks(t: Tables) -> DataFrame:
    """The masks of images and their crops after filters and suppression."""
    found = generation.generated(images_of(t), "bands", SET)
    rounded = [F.round(c, n).alias(c) for c, n in (("x", 4), ("y", 4), ("quality", 6), ("stability", 6))]
    return found.select("image", "crop", "point", "candidate", *rounded, "area", *[F.col(c).cast("long").alias(c) for c in ("left", "top", "right", "bottom")])


#: All candidates at a higher threshold, without filters.
RAW = generation.Settings(side=SIDE, quality=-1.0, stability=0.0, threshold=4.0, offset=4.0, suppress=100, slack=-1.0)
AREAS = f"""WITH im AS ({IMAGES}), ask AS (SELECT *, CAST(floor((point % {SIDE} + 0.5::DOUBLE) / {SIDE} * {WIDTH}) AS BIGINT) AS x, CAST(floor((point // {SIDE} + 0.5::DOUBLE) / {SIDE} * {HEIGHT}) AS BIGINT) AS y
        FROM im, (SELECT unnest(range(0, {SIDE * SIDE})) AS point)), seen AS (SELECT * EXCLUDE (x, y), {VALUE} AS own FROM ask),
    px AS (SELECT image, point, abs({VALUE} - own) AS far FROM seen, (SELECT unnest(range(0, {WIDTH})) AS x), (SELECT unnest(range(0, {HEIGHT})) AS y))
    SELECT image, CAST(point AS INTEGER) AS point, candidate, CAST(count(*) AS BIGINT) AS area FROM px, (SELECT unnest([8, 24, 72]) AS wide, unnest([0, 1, 2]) AS candidate) WHERE wide - far > 4"""


@query(AREAS + " GROUP BY ALL")
def mask_threshold(t: Tables) -> DataFrame:
    """Pixels whose logit is above a threshold, in every candidate mask."""
    return generation.generated(images_of(t), "bands", RAW).select("image", "point", "candidate", "area")


@query(AREAS + " AND candidate > 0 GROUP BY ALL")
def multimask_slice(t: Tables) -> DataFrame:
    """The candidates of a point but for the first."""
    return generation.generated(images_of(t), "bands", replace(RAW, skip_first=True)).select("image", "point", "candidate", "area")
