"""Queries on pixels, contours and candidates of masks; line items stand for both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid import functions as E
from ethogrid.operators import masks

from .embeddings import GOOD, vectors_of
from .masks import HEIGHT, PARTS, PIXELS, RLE, WIDTH, pixels_of, runs_of
from .registry import Tables, query
from .training import seeded

#: The chain's walk: from a state (pixel, where it came from) to the next one, until the first comes again.
CHAIN = PARTS + """, sizes AS (SELECT frame, roi, component, sum(x1 - x0) AS area FROM num JOIN lab USING (frame, roi, n) GROUP BY ALL),
    big AS (SELECT frame, roi, arg_max(component, (area, -component)) AS component FROM sizes GROUP BY ALL),
    own AS MATERIALIZED (SELECT frame, roi, y, unnest(range(x0, x1)) AS x FROM num JOIN lab USING (frame, roi, n) JOIN big USING (frame, roi, component)),
    around AS (SELECT unnest(range(0, 8)) AS k, unnest([0, -1, -1, -1, 0, 1, 1, 1]) AS dy, unnest([1, 1, 0, -1, -1, -1, 0, 1]) AS dx),
    ways AS MATERIALIZED (SELECT a.frame, a.roi, a.y, a.x, list(k ORDER BY k) AS ways FROM own a, around JOIN own b ON b.frame = a.frame AND b.roi = a.roi AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL),
    firsts AS (SELECT frame, roi, min((y, x)) AS at FROM own GROUP BY ALL),
    starts AS (SELECT f.frame, f.roi, f.at[1] AS y, f.at[2] AS x, list_filter([3, 2, 1, 0, 7, 6, 5], lambda k: list_contains(ways, k))[1] AS back
        FROM firsts f LEFT JOIN ways w ON w.frame = f.frame AND w.roi = f.roi AND w.y = f.at[1] AND w.x = f.at[2]),
    walk AS (
        SELECT frame, roi, y, x, y AS ny, x AS nx, back, back AS shuts, y AS ey, x AS ex, 0::BIGINT AS place, back IS NULL AS corner, back IS NULL AS shut FROM starts
        UNION ALL
        SELECT frame, roi, ny, nx, ny + dy, nx + dx, (k + 4) %% 8, shuts, ey, ex, place + 1, k <> (back + 4) %% 8, ny + dy = ey AND nx + dx = ex AND (k + 4) %% 8 = shuts FROM (
        SELECT walk.*, list_filter([(back + i) %% 8 for i in range(1, 9)], lambda k: list_contains(ways, k))[1] AS way FROM walk JOIN ways ON ways.frame = walk.frame AND ways.roi = walk.roi AND ways.y = ny AND ways.x = nx
        WHERE NOT shut) JOIN around ON k = way),
    chain AS (SELECT frame, roi, y, x, CASE WHEN back IS NULL THEN 0 ELSE place - 1 END AS place, corner FROM walk WHERE place > 0 OR back IS NULL),
    near AS (SELECT frame, roi, y, x, CAST((x - %d) * (x - %d) + (y - %d) * (y - %d) AS BIGINT) AS d2, count(*) OVER (PARTITION BY frame, roi) AS n, place FROM chain WHERE corner
        QUALIFY n > 1 AND row_number() OVER (PARTITION BY frame, roi ORDER BY d2, place) = 1)
""" % (WIDTH // 2, WIDTH // 2, HEIGHT // 2, HEIGHT // 2)


def chain_of(t: Tables) -> DataFrame:
    return masks.contour(runs_of(t))


@query(CHAIN + "SELECT frame, roi, place, y, x, corner FROM chain")
def outer_contour(t: Tables) -> DataFrame:
    """The outer border of each mask's largest part, as a chain."""
    return chain_of(t)


@query(CHAIN + "SELECT frame, roi, y, x, d2 FROM near")
def closest_contour_point(t: Tables) -> DataFrame:
    """The contour's corner closest to the middle."""
    return masks.closest(chain_of(t), WIDTH // 2, HEIGHT // 2).withColumn("d2", F.col("d2").cast("long"))


@query(CHAIN + f"SELECT frame, round(degrees(atan2(y - {HEIGHT // 2}, x - {WIDTH // 2})) - 90, 6) AS angle FROM near WHERE roi = 2")
def contour_turn(t: Tables) -> DataFrame:
    """Degrees by which a frame is turned so that the closest corner of the second ROI's contour is above the middle."""
    near = masks.closest(masks.contour(runs_of(t).where("roi = 2")), WIDTH // 2, HEIGHT // 2)
    return near.select("frame", F.round(E.turn_angle(F.lit(WIDTH // 2), F.lit(HEIGHT // 2), F.col("x"), F.col("y")), 6).alias("angle"))


@query(PIXELS + "SELECT frame, roi, CAST(y // 14 AS BIGINT) AS by, CAST(x // 14 AS BIGINT) AS bx, CAST(count(*) AS BIGINT) AS n FROM px GROUP BY ALL")
def patch_counts(t: Tables) -> DataFrame:
    """Mask pixels in each patch of 14 by 14."""
    return masks.blocks(pixels_of(t), 14)


@query(PIXELS + "SELECT frame, roi, count(*) AS area FROM px GROUP BY ALL HAVING count(*) > 100")
def min_pixels(t: Tables) -> DataFrame:
    """Masks of more than 100 pixels."""
    return masks.large_enough(pixels_of(t), 100)


@query(PIXELS + f"""SELECT DISTINCT px.frame, px.roi, ny AS y, nx AS x FROM px, (SELECT unnest(range(0, 48)) AS ny) a, (SELECT unnest(range(0, 25)) AS nx) b
    WHERE px.y = ny * {HEIGHT} // 48 AND px.x = nx * {WIDTH} // 25""")
def resized_mask(t: Tables) -> DataFrame:
    """Masks at another size, by the nearest pixel up and to the left."""
    return masks.scaled(pixels_of(t), HEIGHT, WIDTH, 48, 25)


@query(PIXELS + "SELECT frame, roi, y + frame % 7 AS y, x0 + frame % 5 AS x0, x1 + frame % 5 AS x1 FROM runs")
def uncrop_masks(t: Tables) -> DataFrame:
    """Masks of crops in the image's own coordinates."""
    return masks.moved_back(runs_of(t), F.col("frame") % 5, F.col("frame") % 7)


@query(PIXELS + f""", tries AS (SELECT frame, turn, {seeded('frame * 31 + turn + 1', HEIGHT - 16 + 1, 17)} AS top, {seeded('frame * 31 + turn + 1', WIDTH - 24 + 1, 23)} AS "left"
        FROM (SELECT DISTINCT frame, unnest(range(0, 5)) AS turn FROM px)),
    inside AS (SELECT t.frame, turn, top, "left", roi, count(*) AS n FROM tries t JOIN px ON px.frame = t.frame AND y >= top AND y < top + 16 AND x >= "left" AND x < "left" + 24 GROUP BY ALL HAVING count(*) > 100),
    large AS (SELECT frame, turn, list(roi ORDER BY roi) AS objects FROM (SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY frame, turn ORDER BY {seeded('frame * 31 + roi + 1', 1 << 30, 5)}, roi) <= 1) GROUP BY ALL)
    SELECT frame, CAST(turn AS INTEGER) AS turn, top, "left", objects IS NOT NULL AS good, coalesce(array_to_string(objects, ','), '') AS objects FROM tries LEFT JOIN large USING (frame, turn)
    QUALIFY row_number() OVER (PARTITION BY frame ORDER BY objects IS NULL, CASE WHEN objects IS NULL THEN -turn ELSE turn END) = 1""")
def object_crops(t: Tables) -> DataFrame:
    """A window of each frame that holds more than 100 pixels of an object, one object kept."""
    found = masks.balanced_crops(runs_of(t), HEIGHT, WIDTH, 16, 24, least=100, most=1)
    return found.withColumn("objects", F.array_join("objects", ","))


@query()
def reclean_suppress(t: Tables) -> DataFrame:
    """Cleaned masks after a second suppression of their boxes, unchanged ones first."""
    px = pixels_of(t)
    scores = px.groupBy("frame", "roi").agg(F.min(F.col("x") * 1000 + F.col("y")).alias("score"))
    return masks.recleaned(masks.runs_of(px), scores, HEIGHT, WIDTH, 6).select("frame", "roi", "y", "x0", "x1", "score")


@query(RLE + f""", c AS (SELECT frame, roi, CASE WHEN hi < {HEIGHT * WIDTH} THEN list_append(counts, {HEIGHT * WIDTH} - hi) ELSE counts END AS c FROM enc),
    d AS (SELECT frame, roi, i, CAST(CASE WHEN i > 3 THEN c[i] - c[i - 2] ELSE c[i] END AS BIGINT) AS x FROM (SELECT frame, roi, c, unnest(range(1, len(c) + 1)) AS i FROM c)),
    b AS (SELECT frame, roi, i, k, x >> (5 * k) AS rest, x >> (5 * k + 5) AS after FROM d, (SELECT unnest(range(0, 7)) AS k)),
    m AS (SELECT frame, roi, i, k, rest & 31 AS low, CASE WHEN (rest & 31) >= 16 THEN after <> -1 ELSE after <> 0 END AS more FROM b),
    gone AS (SELECT *, coalesce(bool_and(more) OVER (PARTITION BY frame, roi, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS going FROM m)
    SELECT frame, roi, string_agg(chr(CAST(48 + low + CASE WHEN more THEN 32 ELSE 0 END AS INTEGER)), '' ORDER BY i, k) AS counts FROM gone WHERE going GROUP BY frame, roi""")
def rle_string(t: Tables) -> DataFrame:
    """Run lengths as compressed strings."""
    return masks.encode(pixels_of(t), HEIGHT, WIDTH).select("frame", "roi", E.compressed_counts(F.col("counts")).alias("counts"))


@query(GOOD + "SELECT vec_id, CAST(i AS INTEGER) AS identity, CASE WHEN i > label THEN -1e10 ELSE round(v[i], 6) END AS logit FROM (SELECT vec_id, label, v, unnest(range(1, 11)) AS i FROM good)")
def unused_identities(t: Tables) -> DataFrame:
    """Logits of ten identities; those beyond the number of objects never win."""
    rows = vectors_of(t).select("vec_id", "label", F.posexplode(F.slice("v", 1, 10)).alias("i", "x"))
    return rows.select("vec_id", (F.col("i") + 1).alias("identity"), E.without_unused(F.round("x", 6), F.col("i") + 1, F.col("label")).alias("logit"))


@query(GOOD + """, e AS (SELECT vec_id, unnest(v[1:6]) * 10 AS x, unnest(range(0, 6)) AS place FROM good), m AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS r FROM e)
    SELECT vec_id, CAST(place AS INTEGER) AS place, round(r / sum(r) OVER (PARTITION BY vec_id), 6) AS share FROM m""")
def softmax_shares(t: Tables) -> DataFrame:
    """Class shares of six logits."""
    rows = vectors_of(t).select("vec_id", F.posexplode(E.softmax(F.transform(F.slice("v", 1, 6), lambda x: x * 10))).alias("place", "share"))
    return rows.select("vec_id", "place", F.round("share", 6).alias("share"))


@query(GOOD + """, e AS (SELECT vec_id, unnest(v[1:12]) * 10 AS x, unnest(range(0, 12)) AS place FROM good), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, place) <= 3 AS top FROM e),
    m AS (SELECT *, CASE WHEN top THEN exp(x - max(x) OVER (PARTITION BY vec_id)) ELSE 0 END AS r FROM k)
    SELECT vec_id, CAST(place AS INTEGER) AS place, round(r / sum(r) OVER (PARTITION BY vec_id), 6) AS share FROM m""")
def attention_topk(t: Tables) -> DataFrame:
    """Shares of the three largest of twelve scores."""
    rows = vectors_of(t).select("vec_id", F.posexplode(E.attention(F.transform(F.slice("v", 1, 12), lambda x: x * 10), 3)).alias("place", "share"))
    return rows.select("vec_id", "place", F.round("share", 6).alias("share"))


@query("""SELECT p_partkey, round((p_partkey % 256 / 255.0 - 0.485) / 0.229, 6) AS red, round((p_size / 255.0 - 0.456) / 0.224, 6) AS green,
    round((p_partkey % 100 / 255.0 - 0.406) / 0.225, 6) AS blue FROM part""")
def normalised_pixels(t: Tables) -> DataFrame:
    """Channels scaled to one, less their mean, over their spread."""
    red, green, blue = F.col("p_partkey") % 256, F.col("p_size"), F.col("p_partkey") % 100
    rounded = lambda c, m, s: F.round(E.standardised(c, m, s), 6)
    return t.part.select("p_partkey", rounded(red, 0.485, 0.229).alias("red"), rounded(green, 0.456, 0.224).alias("green"), rounded(blue, 0.406, 0.225).alias("blue"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_returnflag WHEN 1 THEN l_returnflag || l_linestatus WHEN 2 THEN l_linestatus END AS shown FROM lineitem""")
def display_mode(t: Tables) -> DataFrame:
    """What a viewer shows in each mode."""
    mode = F.element_at(F.array(*map(F.lit, ("image", "overlay", "mask", "other"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    shown = E.shown_mode(mode, F.col("l_returnflag"), F.concat("l_returnflag", "l_linestatus"), F.col("l_linestatus"))
    return t.lineitem.select("l_orderkey", "l_linenumber", shown.alias("shown"))


@query(PIXELS + f""", o AS (SELECT frame, roi, count(*) AS n FROM px GROUP BY ALL)
    SELECT frame, CAST({HEIGHT * WIDTH} - sum(n) AS BIGINT) AS white, CAST({HEIGHT * WIDTH} AS BIGINT) AS pixels FROM o GROUP BY frame""")
def blank_page(t: Tables) -> DataFrame:
    """Frames on a blank page: how much of it stays white without the masked parts."""
    covered = pixels_of(t).groupBy("frame").agg(F.count("*").alias("n"))
    page = F.lit(HEIGHT * WIDTH).cast("long")
    return covered.select("frame", (page - F.col("n")).alias("white"), page.alias("pixels"))
