"""Queries on project state: names, labels, clusters and files of a project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid import functions as E
from ethogrid import sources
from ethogrid.operators import latents

from .embeddings import GOOD, vectors_of
from .registry import Tables, query


@query("SELECT page_id, regexp_replace(url || '.JPG', '(?i)\\.jpe?g$', '.png') AS name FROM pages")
def mask_names(t: Tables) -> DataFrame:
    """The names of images' mask files."""
    return t.pages.select("page_id", E.mask_name(F.concat("url", F.lit(".JPG"))).alias("name"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%d-%H-%M-%S') || '-Project' END AS name FROM orders")
def project_names(t: Tables) -> DataFrame:
    """Names that were entered, or are made of the time."""
    entered = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, F.lit(""))
    return t.orders.select("o_orderkey", E.project_name(entered, F.col("o_orderdate")).alias("name"))


@query("SELECT event_id, CAST(event_id * 512 * 30000 // (15360 * 1001) AS BIGINT) AS frame FROM events")
def pts_frames(t: Tables) -> DataFrame:
    """Frames at presentation times, at a time base of 512 / 15360 and 30000 / 1001 frames a second."""
    n = lambda x: F.lit(x).cast("long")
    return t.events.select("event_id", E.pts_frame(F.col("event_id"), n(512), n(15_360), n(30_000), n(1_001)).alias("frame"))


@query(GOOD + ", r AS (SELECT min(v[1]) AS low, max(v[1]) AS high FROM good) SELECT vec_id, round(low + (high - low) * (vec_id % 640) / 640.0, 6) AS x FROM good, r")
def pixel_to_embedding(t: Tables) -> DataFrame:
    """Places on a plotted axis."""
    rows = vectors_of(t).select("vec_id", F.element_at("v", 1).alias("x"))
    span = rows.agg(F.min("x").alias("low"), F.max("x").alias("high")).hint("broadcast")  # one row
    return rows.join(span).select("vec_id", F.round(E.from_pixel(F.col("vec_id") % 640, 640, F.col("low"), F.col("high")), 6).alias("x"))


@query("""WITH m AS (SELECT o_custkey AS id, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE MAP {'a': o_custkey, 'b': 1} END AS m FROM orders GROUP BY o_custkey)
    SELECT id, coalesce(m['a'], -1) AS a, CAST(id * 2 AS BIGINT) AS b FROM m""")
def map_upsert(t: Tables) -> DataFrame:
    """Entries of a configuration after one was set."""
    rows = t.orders.select(F.col("o_custkey").alias("id")).distinct()
    held = F.when(F.col("id") % 3 != 0, F.create_map(F.lit("a"), F.col("id"), F.lit("b"), F.lit(1).cast("long")))
    now = rows.select("id", E.upserted(held, F.lit("b"), F.col("id") * 2).alias("m"))
    return now.select("id", F.coalesce(F.col("m")["a"], F.lit(-1).cast("long")).alias("a"), F.col("m")["b"].alias("b"))


@query("SELECT DISTINCT l_suppkey AS video, l_orderkey AS frame, arg_max(l_partkey, (l_linenumber, l_partkey)) AS mask FROM lineitem GROUP BY ALL")
def label_write(t: Tables) -> DataFrame:
    """Labels after upserts: the newest of each frame."""
    rows = t.lineitem.select(F.col("l_suppkey").alias("video"), F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("mask"), F.struct("l_linenumber", "l_partkey").alias("version"))
    return sources.newest(rows, ["video", "frame"], "version").select("video", "frame", "mask")


@query("SELECT 'total_frames' AS key, CAST(user_id AS VARCHAR) AS video, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY user_id UNION ALL SELECT 'roi_count', CAST(user_id AS VARCHAR), 2 FROM events GROUP BY user_id")
def scalar_config(t: Tables) -> DataFrame:
    """Scalars of each video, written twice and read back by key."""
    n = t.events.groupBy(F.col("user_id").cast("string").alias("video")).agg(F.count("*").cast("double").alias("n"))
    old = n.select("video", F.explode(F.create_map(F.lit("total_frames"), F.lit(-1.0), F.lit("roi_count"), F.lit(2.0))).alias("key", "value"), F.lit(1).alias("version"))
    new = n.select("video", F.lit("total_frames").alias("key"), F.col("n").alias("value"), F.lit(2).alias("version"))
    return sources.scalars(old.unionByName(new)).select("key", "video", "value")


@query("""WITH v AS (SELECT DISTINCT 'v' || user_id || '.mp4' AS video FROM events), f AS (SELECT DISTINCT 'v' || vec_id % 300 || '_ROI_' || (label % 3 + 1) || CASE WHEN label % 2 = 0 THEN '_rotation' ELSE '' END || '_latent.npz' AS file FROM embeddings),
    p AS (SELECT file, regexp_extract(file, '^(.*)_ROI_', 1) AS base, CAST(regexp_extract(file, '_ROI_([0-9]+)_', 1) AS INTEGER) AS roi, CASE WHEN contains(file, '_rotation_') THEN 'rotation' ELSE 'plain' END AS kind FROM f)
    SELECT v.video, p.roi, p.kind, p.file FROM v LEFT JOIN p ON p.base || '.mp4' = v.video""")
def video_latents(t: Tables) -> DataFrame:
    """Videos with the latents whose file names bear theirs; those without any are there once."""
    videos = t.events.select(F.concat(F.lit("v"), "user_id", F.lit(".mp4")).alias("video")).distinct()
    kind = F.when(F.col("label") % 2 == 0, "_rotation").otherwise("")
    files = t.embeddings.select(F.concat(F.lit("v"), F.col("vec_id") % 300, F.lit("_ROI_"), F.col("label") % 3 + 1, kind, F.lit("_latent.npz")).alias("file")).distinct()
    return sources.latents_of(videos, files)


CLUSTERS = "WITH c AS (SELECT vec_id AS bin, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE vec_id % 3 END AS cluster, label FROM embeddings)\n"


def clusters_of(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("bin"), F.when(F.col("vec_id") % 10 == 0, -1).otherwise(F.col("vec_id") % 3).cast("int").alias("cluster"), "label")


@query(CLUSTERS + "SELECT bin, CAST(CASE WHEN cluster = -1 THEN -1 ELSE 0 END AS INTEGER) AS cluster FROM c")
def clear_labels(t: Tables) -> DataFrame:
    """Labels cleared."""
    return latents.cleared(clusters_of(t).select("bin", "cluster"))


SHADES = ["#1b9e77", "#d95f02", "#7570b3", "#e7298a", "#66a61e", "#e6ab02"]
#: Ten clusters have had names, of which three are left; two colors are in use.
SPLIT = CLUSTERS + f""", meta AS (SELECT DISTINCT CAST(label AS INTEGER) AS cluster, 'C' || label AS name, CASE WHEN label % 2 = 0 THEN '#d95f02' ELSE '#e7298a' END AS color FROM embeddings),
    l AS (SELECT bin, CASE WHEN label % 4 = 0 THEN -1 ELSE label % 4 END AS part FROM c WHERE cluster = 1), p AS (SELECT part, dense_rank() OVER (ORDER BY part) AS place FROM (SELECT DISTINCT part FROM l WHERE part >= 0)),
    fresh AS (SELECT part, CAST((SELECT max(cluster) FROM meta) + place AS INTEGER) AS cluster, ['{SHADES[0]}', '{SHADES[2]}', '{SHADES[4]}', '{SHADES[5]}'][part % 4 + 1] AS color FROM p)
"""


def _split(t: Tables) -> tuple[DataFrame, DataFrame]:
    current = clusters_of(t)
    local = current.where("cluster = 1").select("bin", F.when(F.col("label") % 4 == 0, -1).otherwise(F.col("label") % 4).alias("cluster"))
    color = F.when(F.col("label") % 2 == 0, SHADES[1]).otherwise(SHADES[3])
    meta = t.embeddings.select("label").distinct().select(F.col("label").cast("int").alias("cluster"), F.concat(F.lit("C"), "label").alias("name"), color.alias("color"))
    return latents.split(current.select("bin", "cluster"), local, 1, meta, SHADES)


@query(SPLIT + "SELECT c.bin, CAST(CASE WHEN c.cluster = 1 THEN coalesce(fresh.cluster, c.cluster) ELSE c.cluster END AS INTEGER) AS cluster FROM c LEFT JOIN l USING (bin) LEFT JOIN fresh USING (part)")
def cluster_split(t: Tables) -> DataFrame:
    """A cluster split into numbered parts; noise keeps the parent."""
    return _split(t)[0]


@query(SPLIT + "SELECT cluster, name, color FROM meta UNION ALL SELECT cluster, 'C' || cluster, color FROM fresh")
def cluster_split_meta(t: Tables) -> DataFrame:
    """Names and colors after the split."""
    return _split(t)[1]


@query("SELECT DISTINCT label AS cluster, CASE WHEN label = 3 THEN 'rear' ELSE 'C' || label END AS name FROM embeddings")
def cluster_rename(t: Tables) -> DataFrame:
    """Names of clusters after one was changed."""
    meta = t.embeddings.select(F.col("label").alias("cluster")).distinct().withColumn("name", F.concat(F.lit("C"), "cluster"))
    return latents.renamed(meta, 3, "rear")


@query("SELECT string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS label FROM embeddings) WHERE label <> -1")
def run_labels(t: Tables) -> DataFrame:
    """The distinct labels of a timeline but for noise."""
    label = F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label"))
    return t.embeddings.agg(F.array_join(F.array_remove(F.array_sort(F.collect_set(label)), -1), ",").alias("labels"))


@query(GOOD + """, e AS (SELECT unnest(v) AS x, unnest(range(0, len(v))) AS place FROM good), s AS (SELECT place, var_pop(x) AS variance FROM e GROUP BY place)
    SELECT CAST(place AS INTEGER) AS place, round(variance, 6) AS variance, CAST(row_number() OVER (ORDER BY variance DESC, place) AS INTEGER) AS rank FROM s QUALIFY rank <= 20""")
def variable_features(t: Tables) -> DataFrame:
    """The twenty elements that vary most."""
    return latents.most_variable(vectors_of(t), "v", 20).select("place", F.round("variance", 6).alias("variance"), "rank")
