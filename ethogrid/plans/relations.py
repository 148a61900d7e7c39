"""Queries on filters, joins, sets, sequences and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethogrid import functions as E
from ethogrid.operators import boxes, metrics, sequences

from .registry import Tables, query

#: A total order of the boxes' rows.
TIE = ("l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
BOX = """WITH box AS (SELECT l_orderkey % 2000 AS grp, l_partkey % 64 AS x0, l_suppkey % 48 AS y0, l_partkey % 64 + 4 + CAST(l_quantity AS BIGINT) % 24 AS x1,
    l_suppkey % 48 + 4 + 3 * l_linenumber AS y1, l_extendedprice AS score, l_discount AS st, * FROM lineitem)
"""


def boxes_of(t: Tables) -> DataFrame:
    x0, y0 = F.col("l_partkey") % 64, F.col("l_suppkey") % 48
    return t.lineitem.select(
        (F.col("l_orderkey") % 2000).alias("grp"), x0.alias("x0"), y0.alias("y0"), (x0 + 4 + F.col("l_quantity").cast("long") % 24).alias("x1"),
        (y0 + 4 + 3 * F.col("l_linenumber")).alias("y1"), F.col("l_extendedprice").alias("score"), F.col("l_discount").alias("st"), *TIE,
    )


@query("SELECT o_orderkey AS frame, o_custkey AS video, l_partkey AS mask, l_linenumber AS part FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def frame_mask_join(t: Tables) -> DataFrame:
    """Frames with their masks, by key."""
    masks = t.lineitem.select(F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("mask"), F.col("l_linenumber").alias("part"))
    return t.orders.select(F.col("o_orderkey").alias("frame"), F.col("o_custkey").alias("video")).join(masks, "frame")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def registered_anti_join(t: Tables) -> DataFrame:
    """What isn't registered yet."""
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def label_semi_join(t: Tables) -> DataFrame:
    """Frames that have a label file."""
    return t.documents.join(t.labels, "doc_id", "left_semi").select("doc_id", "lang", "source")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '\\.(html|org|com)$')")
def extension_filter(t: Tables) -> DataFrame:
    """Names with wanted extensions, in any case."""
    return t.pages.where(E.extension(F.col("url")).isin("html", "org", "com")).select("page_id", "url")


@query("""SELECT doc_id, regexp_replace(source || '.take.mp4', '\\.[^.]+$', '') AS name, split_part(source || '.take.mp4', '.', 1) AS base,
    printf('%s_ROI_%d_latent.npz', source, doc_id % 3) AS latent_name, (doc_id % 3) = 0 AS is_movie FROM documents""")
def file_names(t: Tables) -> DataFrame:
    """Names with the last extension cut, cut at the first dot, and built for latents."""
    name = F.concat("source", F.lit(".take.mp4"))
    kind = F.when(F.col("doc_id") % 3 == 0, F.lit("a.MP4")).otherwise(F.lit("a.txt"))
    return t.documents.select(
        "doc_id", E.strip_extension(name).alias("name"), E.base_name(name).alias("base"), F.format_string("%s_ROI_%d_latent.npz", "source", F.col("doc_id") % 3).alias("latent_name"),
        E.is_video(kind).alias("is_movie"),
    )


@query("""WITH s AS (SELECT DISTINCT source FROM documents) SELECT source, CAST(row_number() OVER (ORDER BY CAST(substr(source, 4) AS INTEGER)) AS INTEGER) AS natural_rank,
    CAST(row_number() OVER (ORDER BY source) AS INTEGER) AS text_rank FROM s""")
def natural_sort(t: Tables) -> DataFrame:
    """Sources by number and by code point."""
    names = t.documents.select("source").distinct()
    rank = lambda c: F.row_number().over(Window.orderBy(c))
    return names.select("source", rank(E.natural_key(F.col("source"))).alias("natural_rank"), rank("source").alias("text_rank"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN (SELECT r_name FROM region) AND n_nationkey NOT IN (SELECT r_regionkey FROM region)")
def palette_except(t: Tables) -> DataFrame:
    """Colours that aren't in use: an ordered difference."""
    free = t.nation.join(t.region, F.col("n_name") == F.col("r_name"), "left_anti")
    return free.join(t.region, F.col("n_nationkey") == F.col("r_regionkey"), "left_anti").select("n_nationkey", "n_name")


OBJECTS = "WITH seen AS (SELECT DISTINCT l_suppkey AS sequence, l_orderkey AS frame, l_partkey % 50 AS object FROM lineitem)\n"


def seen_of(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_suppkey").alias("sequence"), F.col("l_orderkey").alias("frame"), (F.col("l_partkey") % 50).alias("object")).distinct()


@query(OBJECTS + """, f AS (SELECT sequence, object, min(frame) AS frame FROM seen GROUP BY ALL), n AS (SELECT sequence, frame, count(*) AS new FROM f GROUP BY ALL),
    a AS (SELECT DISTINCT sequence, frame FROM seen), j AS (SELECT a.*, coalesce(new, 0) AS new FROM a LEFT JOIN n USING (sequence, frame))
    SELECT sequence, frame, CAST(CASE WHEN row_number() OVER w = 1 THEN new ELSE coalesce(sum(new) OVER (PARTITION BY sequence ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS BIGINT) AS known
    FROM j WINDOW w AS (PARTITION BY sequence ORDER BY frame)""")  # fmt: skip
def cumulative_objects(t: Tables) -> DataFrame:
    """Objects known before each frame."""
    return sequences.cumulative_objects(seen_of(t))


@query(OBJECTS + """, g AS (SELECT sequence, object FROM seen GROUP BY ALL HAVING count(DISTINCT frame) >= 2)
    SELECT sequence, CAST(count(DISTINCT object) AS BIGINT) AS objects, CAST(count(DISTINCT frame) AS BIGINT) AS images FROM seen JOIN g USING (sequence, object) GROUP BY sequence HAVING count(DISTINCT frame) >= 2""")
def train_catalog(t: Tables) -> DataFrame:
    """Sequences that can train."""
    return sequences.trainable(seen_of(t))


@query(OBJECTS + """, s AS (SELECT sequence, min(frame) AS lo, max(frame) AS hi FROM seen WHERE object < 5 GROUP BY sequence)
    SELECT DISTINCT seen.sequence, seen.frame FROM seen JOIN s ON seen.sequence = s.sequence AND frame >= lo AND frame <= hi""")
def dense_sequence_scan(t: Tables) -> DataFrame:
    """All frames between the first and last labelled one."""
    seen = seen_of(t)
    return sequences.dense_span(seen.where("object < 5"), seen.select("sequence", "frame").distinct())


@query("""WITH o AS (SELECT l_orderkey AS frame, list_sort(list_distinct(list(l_linenumber))) AS objects, list_sort(list_distinct(list(l_linenumber) FILTER (l_suppkey % 2 = 0))) AS ref FROM lineitem GROUP BY 1)
    SELECT frame, len(list_filter(objects, lambda x: x <> 0 AND NOT list_contains(coalesce(ref, []), x))) = 0 AS inside, CAST(len(objects) AS INTEGER) AS n FROM o""")
def object_containment(t: Tables) -> DataFrame:
    """Whether a frame's objects are all in its reference."""
    every, ref = F.array_sort(F.collect_set("l_linenumber")), F.collect_set(F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linenumber")))
    sets = t.lineitem.groupBy(F.col("l_orderkey").alias("frame")).agg(every.alias("objects"), ref.alias("ref"))
    return sets.select("frame", sequences.contained(F.col("objects"), F.col("ref")).alias("inside"), F.size("objects").alias("n"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS frame, l_partkey AS label FROM lineitem WHERE l_partkey <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY label) AS local FROM d)
    SELECT l_orderkey AS frame, l_partkey AS label, CAST(coalesce(local, 0) AS INTEGER) AS local, CAST(coalesce(local, 0) > 0 AS INTEGER) AS hot
    FROM lineitem LEFT JOIN r ON frame = l_orderkey AND label = l_partkey""")
def relabel_objects(t: Tables) -> DataFrame:
    """Labels squeezed to 1 .. n in each frame, and a one-hot check bit."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("label"))
    local = sequences.relabelled(rows, "frame", "label")
    bit = F.aggregate(F.slice(E.one_hot(F.col("local"), 16), 2, 16), F.lit(0), lambda a, x: a + x)
    return local.select("frame", "label", F.col("local").cast("int").alias("local"), F.when(F.col("local") > 16, 1).otherwise(bit).alias("hot"))


@query("SELECT l_linenumber AS label, list_transform(range(0, 8), lambda i: CAST(i = l_linenumber AS INTEGER))::VARCHAR AS planes, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def one_hot(t: Tables) -> DataFrame:
    """One-hot planes of labels."""
    planes = F.concat(F.lit("["), F.array_join(E.one_hot(F.col("label"), 7), ", "), F.lit("]"))
    return t.lineitem.groupBy(F.col("l_linenumber").alias("label")).agg(F.count("*").alias("n")).select("label", planes.alias("planes"), "n")


@query(BOX + "SELECT grp, x0, y0, x1, y1, score, st FROM box WHERE score > 30000 AND st >= 0.05")
def quality_filter(t: Tables) -> DataFrame:
    """Strict on quality, inclusive on stability."""
    return boxes_of(t).where((F.col("score") > 30000) & (F.col("st") >= 0.05)).select("grp", "x0", "y0", "x1", "y1", "score", "st")


def _edge(side: str, crop: int, image: int) -> str:
    return f"(abs({side} - {crop}) <= 5 AND NOT abs({side} - {image}) <= 5)"


@query(BOX + f"SELECT grp, x0, y0, x1, y1 FROM box WHERE NOT ({_edge('x0', 16, 0)} OR {_edge('y0', 8, 0)} OR {_edge('x1', 60, 92)} OR {_edge('y1', 40, 73)})")
def crop_edge_filter(t: Tables) -> DataFrame:
    """Boxes that no inner crop edge cuts."""
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return boxes_of(t).where(~boxes.at_crop_edge(box, [16, 8, 60, 40], [0, 0, 92, 73], 5)).select("grp", "x0", "y0", "x1", "y1")


@query(BOX + """SELECT l_orderkey, l_linenumber, x0 + 10 AS x, y0 + 20 AS y, x1 - x0 AS w, y1 - y0 AS h, (x1 - x0) * (y1 - y0) AS area, round(x0 * 1.6::DOUBLE, 6) AS scaled_x, round(y0 * 1.5::DOUBLE, 6) AS scaled_y FROM box""")
def uncrop_boxes(t: Tables) -> DataFrame:
    """Boxes moved by their crop's origin, as x, y, w, h, and scaled."""
    moved = [F.col("x0") + 10, F.col("y0") + 20, F.col("x1") + 10, F.col("y1") + 20]
    x, y, w, h = boxes.to_xywh(moved)
    return boxes_of(t).select(
        "l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), boxes.area(moved).alias("area"), F.round(F.col("x0") * 1.6, 6).alias("scaled_x"),
        F.round(F.col("y0") * 1.5, 6).alias("scaled_y"),
    )


@query("""WITH s AS (SELECT p_partkey, 240 + p_size * 37 AS h, 320 + p_partkey % 900 AS w FROM part)
    SELECT p_partkey, CAST(floor(h * (1024.0::DOUBLE / greatest(h, w)) + 0.5) AS INTEGER) AS nh, CAST(floor(w * (1024.0::DOUBLE / greatest(h, w)) + 0.5) AS INTEGER) AS nw,
    CAST(round_even((h * least(1::DOUBLE, 800::DOUBLE / greatest(h, w)) - 1) / 16, 0) * 16 + 1 AS INTEGER) AS rh, CAST(round_even((w * least(1::DOUBLE, 800::DOUBLE / greatest(h, w)) - 1) / 16, 0) * 16 + 1 AS INTEGER) AS rw FROM s""")
def scale_points(t: Tables) -> DataFrame:
    """Sizes scaled to a long side, and restricted to one more than multiples of 16."""
    h, w = 240 + F.col("p_size") * 37, 320 + F.col("p_partkey") % 900
    (nh, nw), (rh, rw) = E.resized(h, w, 1024), E.restricted(h, w, 800)
    return t.part.select("p_partkey", nh.alias("nh"), nw.alias("nw"), rh.alias("rh"), rw.alias("rw"))


@query("""WITH m AS (SELECT o_orderkey, 1 + o_custkey % 9 AS n, o_orderkey % 101 - 50 AS i FROM orders)
    SELECT o_orderkey, CAST(CASE WHEN n <= 1 THEN 0 WHEN ((i % (2 * (n - 1))) + 2 * (n - 1)) % (2 * (n - 1)) < n THEN ((i % (2 * (n - 1))) + 2 * (n - 1)) % (2 * (n - 1))
    ELSE 2 * (n - 1) - ((i % (2 * (n - 1))) + 2 * (n - 1)) % (2 * (n - 1)) END AS BIGINT) AS reflected, CAST(greatest(0, least(i, n - 1)) AS BIGINT) AS clamped FROM m""")
def reflect_index(t: Tables) -> DataFrame:
    """Indices mirrored, and clamped, into a sequence."""
    n, i = 1 + F.col("o_custkey") % 9, F.col("o_orderkey") % 101 - 50
    return t.orders.select("o_orderkey", E.reflected(i, n).cast("long").alias("reflected"), E.clamped(i, n).cast("long").alias("clamped"))


def _seed(key: str, n: str, salt: int) -> str:
    return f"((({key}) % 4294967291) * 265443576 + {salt * 40_503 + 12_345}) % 4294967291 % ({n})"


@query(f"""WITH s AS (SELECT l_suppkey AS sequence, count(DISTINCT l_orderkey) AS n_frames FROM lineitem GROUP BY 1),
    g AS (SELECT *, {_seed('sequence + 1', '5', 1)} + 1 AS g1, {_seed('sequence + 1', '5', 2)} + 1 AS g2, {_seed('sequence + 1', '5', 3)} + 1 AS g3 FROM s),
    b AS (SELECT *, CASE WHEN n_frames - g1 - g2 - g3 > 0 THEN {_seed('sequence + 1', 'greatest(n_frames - g1 - g2 - g3, 1)', 99)} ELSE 0 END AS start FROM g),
    e AS (SELECT sequence, n_frames AS n, unnest([0, 1, 2, 3]) AS step, unnest([start, start + g1, start + g1 + g2, start + g1 + g2 + g3]) AS i FROM b)
    SELECT sequence, CAST(step AS INTEGER) AS step, CAST(CASE WHEN n <= 1 THEN 0 WHEN i % (2 * (n - 1)) < n THEN i % (2 * (n - 1)) ELSE 2 * (n - 1) - i % (2 * (n - 1)) END AS BIGINT) AS index FROM e""")
def sample_indices(t: Tables) -> DataFrame:
    """Clips with hashed gaps and starts."""
    lengths = t.lineitem.groupBy(F.col("l_suppkey").alias("sequence")).agg(F.countDistinct("l_orderkey").alias("n_frames"))
    return sequences.clip_indices(lengths, 3, 5)


ORDER = ", ".join(("l_extendedprice DESC", *TIE[1:]))


@query("WITH RECURSIVE " + BOX[5:] + f""", r AS MATERIALIZED (SELECT grp, x0, y0, x1, y1, row_number() OVER (PARTITION BY grp ORDER BY {ORDER}) AS k FROM box),
    n AS (SELECT r.grp, r.k, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] AS kept FROM r WHERE k = 1
        UNION ALL SELECT r.grp, r.k, CASE WHEN len(list_filter(n.kept, lambda b: 10 * greatest(least(b.x1, r.x1) - greatest(b.x0, r.x0), 0) * greatest(least(b.y1, r.y1) - greatest(b.y0, r.y0), 0)
            > 3 * ((b.x1 - b.x0) * (b.y1 - b.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) - greatest(least(b.x1, r.x1) - greatest(b.x0, r.x0), 0) * greatest(least(b.y1, r.y1) - greatest(b.y0, r.y0), 0)))) > 0
            THEN n.kept ELSE list_append(n.kept, {{'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1}}) END
        FROM n JOIN r ON r.grp = n.grp AND r.k = n.k + 1),
    last AS (SELECT grp, arg_max(kept, k) AS kept FROM n GROUP BY grp), u AS (SELECT grp, unnest(kept) AS b FROM last)
    SELECT grp, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1 FROM u""")
def box_nms(t: Tables) -> DataFrame:
    """Greedy suppression within every image."""
    return _suppressed(boxes_of(t))


def _suppressed(rows: DataFrame) -> DataFrame:
    order = [-F.col("l_extendedprice"), *[F.col(c) for c in TIE[1:]]]
    return boxes.suppress(rows, "grp", order).select("grp", "x0", "y0", "x1", "y1")


@query("SELECT p_partkey AS image, CAST(i AS INTEGER) AS i, round((i % 4 + 0.5::DOUBLE) / 4 * (320 + p_partkey % 900), 4) AS x, round((i // 4 + 0.5::DOUBLE) / 4 * (240 + p_size * 37), 4) AS y FROM part, (SELECT unnest(range(0, 16)) AS i)")
def grid_points(t: Tables) -> DataFrame:
    """Centres of a 4 by 4 grid in the pixels of each image."""
    points = t.part.select(F.col("p_partkey").alias("image"), (320 + F.col("p_partkey") % 900).alias("w"), (240 + F.col("p_size") * 37).alias("h"), F.posexplode(boxes.grid_points(4)).alias("i", "p"))
    return points.select("image", "i", F.round(F.col("p.x") * F.col("w"), 4).alias("x"), F.round(F.col("p.y") * F.col("h"), 4).alias("y"))


@query("""WITH im AS (SELECT r_regionkey AS image, 640 + 100 * r_regionkey AS width, 480 + 50 * r_regionkey AS height FROM region), l AS (SELECT *, unnest([1, 2]) AS layer FROM im),
    s AS (SELECT *, 1 << layer AS side, CAST(floor(0.34 * least(width, height) * (2.0 / (1 << layer))) AS INTEGER) AS more FROM l),
    z AS (SELECT *, CAST(ceil((more * (side - 1) + width) / side) AS INTEGER) AS w, CAST(ceil((more * (side - 1) + height) / side) AS INTEGER) AS h FROM s),
    i AS (SELECT *, unnest(range(0, side)) AS i FROM z), j AS (SELECT *, unnest(range(0, side)) AS j FROM i)
    SELECT image, 0 AS layer, 0 AS x0, 0 AS y0, width AS x1, height AS y1 FROM im
    UNION ALL SELECT image, layer, CAST(i * (w - more) AS INTEGER), CAST(j * (h - more) AS INTEGER), CAST(least(i * (w - more) + w, width) AS INTEGER), CAST(least(j * (h - more) + h, height) AS INTEGER) FROM j""")
def crop_boxes(t: Tables) -> DataFrame:
    """The full image and two layers of overlapping crops."""
    images = t.region.select(F.col("r_regionkey").alias("image"), (640 + 100 * F.col("r_regionkey")).alias("width"), (480 + 50 * F.col("r_regionkey")).alias("height"))
    return boxes.crop_boxes(images, 2, 0.34)


@query("SELECT l_orderkey % 200 AS frame, round(count(*) FILTER (l_extendedprice > 60000) / count(*) FILTER (l_extendedprice > 40000), 6) AS stability FROM lineitem GROUP BY 1")
def stability_score(t: Tables) -> DataFrame:
    """Share of pixels that stay above a moved threshold."""
    out = metrics.stability(t.lineitem.select((F.col("l_orderkey") % 200).alias("frame"), "l_extendedprice"), "frame", "l_extendedprice", 50000, 10000)
    return out.select("frame", F.round("stability", 6).alias("stability"))


@query("""WITH s AS (SELECT l_linenumber AS object, CASE WHEN l_suppkey % 7 = 0 THEN 255 ELSE CAST(l_returnflag = 'R' AS INTEGER) END AS truth, l_discount * 10 AS score FROM lineitem),
    a AS (SELECT object, sum(score * truth) AS tp, sum(score * (1 - truth)) AS fp, sum((1 - score) * truth) AS fn, sum(score) AS s, sum(truth) AS t FROM s WHERE truth <> 255 GROUP BY object HAVING sum(truth) > 0)
    SELECT object, round(1 - (2 * tp + 1) / (s + t + 1), 6) AS dice, round(1 - (tp + 1e-6) / (tp + 0.7 * fp + 0.3 * fn + 1e-6), 6) AS tversky, round(1 - (tp + 1e-6) / (tp + fp + fn + 1e-6), 6) AS jaccard FROM a""")
def overlap_losses(t: Tables) -> DataFrame:
    """Dice, Tversky and soft Jaccard losses of each object."""
    truth = F.when(F.col("l_suppkey") % 7 == 0, 255).otherwise((F.col("l_returnflag") == "R").cast("int"))
    rows = t.lineitem.select(F.col("l_linenumber").alias("object"), truth.alias("truth"), (F.col("l_discount") * 10).alias("score"))
    return metrics.overlap_losses(rows, 0.7, 0.3).select("object", *[F.round(c, 6).alias(c) for c in ("dice", "tversky", "jaccard")])


@query("""WITH r AS (SELECT l_linenumber AS object, l_extendedprice AS loss, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice DESC) AS place, count(*) OVER (PARTITION BY l_linenumber) AS n FROM lineitem)
    SELECT object, round(avg(loss), 4) AS mean, CAST(count(*) AS BIGINT) AS k FROM r WHERE place <= greatest(floor(n * 0.15), 1) GROUP BY object""")
def topk_mean(t: Tables) -> DataFrame:
    """Mean of the largest 15 percent of losses."""
    out = metrics.top_share_mean(t.lineitem.select(F.col("l_linenumber").alias("object"), F.col("l_extendedprice").alias("loss")), "object", "loss", 0.15)
    return out.select("object", F.round("mean", 4).alias("mean"), "k")


@query("""WITH c AS (SELECT l_orderkey AS image, l_linenumber, l_extendedprice + CASE WHEN l_linenumber = 1 THEN (l_orderkey % 5 - 2.5) * 1000 ELSE 0 END AS score, l_partkey, l_suppkey, l_quantity FROM lineitem)
    SELECT image, CAST(arg_max(l_linenumber, (score, -l_linenumber, l_partkey, l_suppkey, l_quantity)) AS INTEGER) AS best, round(max(score), 4) AS score FROM c GROUP BY image""")
def best_candidate(t: Tables) -> DataFrame:
    """The best of an image's candidate masks; the first is favoured by the number of clicks."""
    favour = F.when(F.col("l_linenumber") == 1, (F.col("l_orderkey") % 5 - 2.5) * 1000).otherwise(0.0)
    rows = t.lineitem.select(F.col("l_orderkey").alias("image"), "l_linenumber", (F.col("l_extendedprice") + favour).alias("score"), "l_partkey", "l_suppkey", "l_quantity")
    rank = F.struct("score", -F.col("l_linenumber"), "l_partkey", "l_suppkey", "l_quantity")
    return rows.groupBy("image").agg(F.max_by("l_linenumber", rank).alias("best"), F.round(F.max("score"), 4).alias("score"))


@query("""WITH c AS (SELECT l_orderkey, l_partkey % 256 AS id, l_partkey + 1 AS obj FROM lineitem)
    SELECT l_orderkey, id, CAST((obj - 1) // 10 AS INTEGER) AS engine, CAST((obj - 1) % 10 + 1 AS INTEGER) AS local,
    CAST(((id >> 0) & 1) * 128 + ((id >> 3) & 1) * 64 + ((id >> 6) & 1) * 32 AS BIGINT) AS red, CAST(((id >> 1) & 1) * 128 + ((id >> 4) & 1) * 64 + ((id >> 7) & 1) * 32 AS BIGINT) AS green FROM c""")
def palette_bits(t: Tables) -> DataFrame:
    """Engine numbers of objects, and colour-map channels of labels."""
    engine, local = E.engine_of(F.col("l_partkey") + 1)
    index = F.col("l_partkey") % 256
    return t.lineitem.select("l_orderkey", index.alias("id"), engine.alias("engine"), local.alias("local"), E.palette_channel(index, 0).alias("red"), E.palette_channel(index, 1).alias("green"))
