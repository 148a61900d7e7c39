"""Queries on masks: line items stand for pixel runs of frames with two ROIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid import functions as E
from ethogrid.operators import kinematics, masks, metrics

from .registry import Tables, query

HEIGHT, WIDTH = 32, 50
PIXELS = """WITH RECURSIVE px AS MATERIALIZED (
    SELECT frame, y, x, min(roi) AS roi FROM (
        SELECT l_orderkey % 200 AS frame, 1 + l_linenumber % 2 AS roi, l_suppkey % 32 AS y, unnest([l_partkey % 48, l_partkey % 48 + 1, l_partkey % 48 + 2]) AS x FROM lineitem) GROUP BY ALL
), isl AS (SELECT *, x - row_number() OVER (PARTITION BY frame, roi, y ORDER BY x) AS island FROM px
), runs AS (SELECT frame, roi, y, min(x) AS x0, max(x) + 1 AS x1 FROM isl GROUP BY frame, roi, y, island)
"""
PARTS = PIXELS + """, num AS (SELECT *, row_number() OVER (PARTITION BY frame, roi ORDER BY y, x0) AS n FROM runs
), e AS (SELECT a.frame, a.roi, a.n AS a, b.n AS b FROM num a JOIN num b ON a.frame = b.frame AND a.roi = b.roi AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1
), reach AS (SELECT frame, roi, n, n AS c FROM num UNION SELECT r.frame, r.roi, e.b, r.c FROM reach r JOIN e ON e.frame = r.frame AND e.roi = r.roi AND e.a = r.n AND r.c < e.b
), lab AS (SELECT frame, roi, n, min(c) AS component FROM reach GROUP BY ALL)
"""


def pixels_of(t: Tables) -> DataFrame:
    start = F.col("l_partkey") % 48
    rows = t.lineitem.select(
        (F.col("l_orderkey") % 200).alias("frame"), (1 + F.col("l_linenumber") % 2).alias("roi"), (F.col("l_suppkey") % 32).alias("y"), F.explode(F.array(start, start + 1, start + 2)).alias("x")
    )
    return rows.groupBy("frame", "y", "x").agg(F.min("roi").alias("roi"))


def runs_of(t: Tables) -> DataFrame:
    return masks.runs_of(pixels_of(t))


@query(PIXELS + "SELECT frame, roi, CAST(count(*) AS BIGINT) AS area, CAST(round_even(avg(x), 0) AS BIGINT) AS x, CAST(round_even(avg(y), 0) AS BIGINT) AS y FROM px GROUP BY ALL")
def roi_area_centroid(t: Tables) -> DataFrame:
    """Area and rounded centroid."""
    return kinematics.areas(pixels_of(t))


@query(PIXELS + "SELECT frame, max(roi) AS rois FROM px GROUP BY frame")
def roi_count(t: Tables) -> DataFrame:
    """The highest label of each frame."""
    return pixels_of(t).groupBy("frame").agg(F.max("roi").alias("rois"))


@query(PIXELS + "SELECT frame, roi, y, x0, x1 FROM runs")
def mask_runs(t: Tables) -> DataFrame:
    """Pixel runs."""
    return runs_of(t)


@query(PIXELS + 'SELECT frame, roi, min(x) AS "left", min(y) AS "top", max(x) AS "right", max(y) AS bottom, CAST(count(*) AS BIGINT) AS area FROM px GROUP BY frame, roi')
def mask_bbox(t: Tables) -> DataFrame:
    """Inclusive boxes."""
    return masks.boxes(runs_of(t))


RLE = PIXELS + f""", pos AS (SELECT frame, roi, x * {HEIGHT} + y AS p FROM px), ri AS (SELECT *, p - row_number() OVER (PARTITION BY frame, roi ORDER BY p) AS island FROM pos),
    rr AS (SELECT frame, roi, min(p) AS lo, max(p) + 1 AS hi FROM ri GROUP BY frame, roi, island), g AS (SELECT *, lo - coalesce(lag(hi) OVER (PARTITION BY frame, roi ORDER BY lo), 0) AS gap FROM rr),
    enc AS (SELECT frame, roi, flatten(list([gap, hi - lo] ORDER BY lo)) AS counts, max(hi) AS hi, sum(hi - lo) AS area FROM g GROUP BY frame, roi)
"""


@query(RLE + f"SELECT frame, roi, array_to_string(CASE WHEN hi < {HEIGHT * WIDTH} THEN list_append(counts, {HEIGHT * WIDTH} - hi) ELSE counts END, ',') AS counts, CAST(area AS BIGINT) AS area FROM enc")
def rle_encode(t: Tables) -> DataFrame:
    """Column-major run lengths and their area."""
    encoded = masks.encode(pixels_of(t), HEIGHT, WIDTH)
    return encoded.select("frame", "roi", F.array_join("counts", ",").alias("counts"), masks.encoded_area(F.col("counts")).alias("area"))


@query(PIXELS + "SELECT frame, roi, y, x FROM px")
def rle_roundtrip(t: Tables) -> DataFrame:
    """Pixels after encoding and decoding."""
    return masks.decode(masks.encode(pixels_of(t), HEIGHT, WIDTH), HEIGHT)


@query(PIXELS + f"SELECT frame, roi, y, {WIDTH} - x1 AS x0, {WIDTH} - x0 AS x1 FROM runs")
def flip_columns(t: Tables) -> DataFrame:
    """Masks mirrored left to right."""
    return masks.flipped(runs_of(t), WIDTH)


@query(PIXELS + """, a AS (SELECT frame, y, x, roi FROM px WHERE roi = 1 OR x % 3 = 0), b AS (SELECT frame, y, x, CASE WHEN x % 5 = 0 THEN 0 ELSE roi + 10 END AS roi FROM px WHERE y % 2 = 0)
    , layers AS (SELECT frame, y, x, roi AS below, CAST(NULL AS INTEGER) AS above FROM a UNION ALL SELECT frame, y, x, CAST(NULL AS INTEGER), roi FROM b)
    SELECT frame, y, x, coalesce(nullif(max(above), 0), max(below)) AS roi FROM layers GROUP BY frame, y, x""")
def overlay_coalesce(t: Tables) -> DataFrame:
    """A new layer over a prediction."""
    px = pixels_of(t)
    over = px.where("y % 2 = 0").withColumn("roi", F.when(F.col("x") % 5 == 0, F.lit(0)).otherwise(F.col("roi") + 10))
    return masks.overlaid(px.where("roi = 1 or x % 3 = 0").select("frame", "y", "x", "roi"), over.select("frame", "y", "x", "roi"))


@query(PIXELS + """, tr AS (SELECT frame, y * 50 + x AS p, roi AS o FROM px), pr AS (SELECT frame, y * 50 + x AS p, CASE WHEN (x + y) % 4 = 0 THEN 3 - roi ELSE roi END AS o FROM px WHERE x % 7 <> 0),
    j AS (SELECT coalesce(t.frame, p.frame) AS frame, t.o AS t, p.o AS p FROM tr t FULL JOIN pr p ON t.frame = p.frame AND t.p = p.p),
    u AS (SELECT frame, unnest(list_distinct(list_filter([t, p], lambda v: v IS NOT NULL))) AS o, t, p FROM j),
    s AS (SELECT frame, o, (count(*) FILTER (t = p) + 1e-6) / (count(*) + 1e-6) AS iou FROM u GROUP BY frame, o HAVING count(*) FILTER (t = o) > 0), f AS (SELECT frame, avg(iou) AS iou FROM s GROUP BY frame)
    SELECT round(coalesce(avg(iou), 1), 6) AS miou FROM f""")
def mean_iou(t: Tables) -> DataFrame:
    """Mean intersection over union of a disturbed prediction."""
    px = pixels_of(t)
    at = (F.col("y") * 50 + F.col("x")).alias("pixel")
    pred = px.where("x % 7 <> 0").select(F.col("frame").alias("sample"), at, F.when((F.col("x") + F.col("y")) % 4 == 0, 3 - F.col("roi")).otherwise(F.col("roi")).alias("object"))
    return metrics.mean_iou(pred, px.select(F.col("frame").alias("sample"), at, F.col("roi").alias("object"))).select(F.round("miou", 6).alias("miou"))


@query(PARTS + """SELECT frame, roi, component, CAST(sum(x1 - x0) AS BIGINT) AS area, round(sum((x0 + x1 - 1) / 2 * (x1 - x0)) / sum(x1 - x0), 6) AS x, round(sum(y * (x1 - x0)) / sum(x1 - x0), 6) AS y
    FROM (SELECT num.*, CAST(component AS INTEGER) AS component FROM num JOIN lab USING (frame, roi, n)) GROUP BY ALL""")
def connected_components(t: Tables) -> DataFrame:
    """8-connected parts with area and centroid."""
    sizes = masks.part_sizes(masks.components_of(runs_of(t)))
    return sizes.select("frame", "roi", "component", "area", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(PARTS + """, s AS (SELECT frame, roi, CAST(component AS INTEGER) AS component, CAST(sum(x1 - x0) AS BIGINT) AS area FROM num JOIN lab USING (frame, roi, n) GROUP BY ALL)
    SELECT frame, roi, arg_max(component, (area, -component)) AS component, max(area) AS area FROM s GROUP BY frame, roi""")
def largest_component(t: Tables) -> DataFrame:
    """The largest part of each mask."""
    return masks.largest(masks.part_sizes(masks.components_of(runs_of(t)))).select("frame", "roi", "component", "area")


@query()
def remove_small_regions(t: Tables) -> DataFrame:
    """Holes filled and islands dropped."""
    return masks.clean(runs_of(t), HEIGHT, WIDTH, 6)


@query(PIXELS + f""", c AS (SELECT frame, CAST(round_even(avg(x), 0) AS BIGINT) AS cx, CAST(round_even(avg(y), 0) AS BIGINT) AS cy FROM px WHERE roi = 1 GROUP BY frame),
    m AS (SELECT runs.frame, roi, y + {HEIGHT // 2} - cy AS y, x0 + {WIDTH // 2} - cx AS x0, x1 + {WIDTH // 2} - cx AS x1 FROM runs JOIN c USING (frame))
    SELECT frame, roi, y - 6 AS y, greatest(x0 - 15, 0) AS x0, least(x1 - 15, 20) AS x1 FROM m WHERE y >= 6 AND y < 26 AND x1 > 15 AND x0 < 35""")
def preprocess_geometry(t: Tables) -> DataFrame:
    """Masks centred on the first ROI and cropped about the middle."""
    px = pixels_of(t)
    centre = kinematics.areas(px.where("roi = 1")).select("frame", F.col("x").alias("cx"), F.col("y").alias("cy"))
    moved = masks.shifted(masks.runs_of(px).join(centre, "frame"), WIDTH // 2 - F.col("cx"), HEIGHT // 2 - F.col("cy"))
    return masks.cropped(moved, 15, 6, 20, 20).select("frame", "roi", "y", "x0", "x1")


@query("SELECT l_orderkey, l_linenumber, round(degrees(atan2(l_suppkey % 48 - 24, l_partkey % 64 - 32)) - 90, 6) AS angle FROM lineitem")
def tail_angle(t: Tables) -> DataFrame:
    """Degrees by which to turn a frame so that a point lies above its centre; -90 for level ones to the right and for the
    centre itself, 90 for those to the left."""
    return _turned(t.lineitem)


def _turned(rows: DataFrame) -> DataFrame:
    return rows.select("l_orderkey", "l_linenumber", F.round(E.turn_angle(F.lit(32), F.lit(24), F.col("l_partkey") % 64, F.col("l_suppkey") % 48), 6).alias("angle"))
