"""Queries on latents: a vector's number is its frame, its label the known class."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid import functions as E
from ethogrid.operators import graph, latents, manifold, metrics, timeline
from ethogrid.session import checkpointing

from .registry import Tables, query

COLORS = ["#1b9e77", "#d95f02", "#7570b3", "#e7298a"]
GOOD = "WITH good AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)\n"


def vectors_of(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def points_of(t: Tables) -> DataFrame:
    """id, x, y: two elements of each vector."""
    return vectors_of(t).select(F.col("vec_id").alias("id"), F.element_at("v", 1).alias("x"), F.element_at("v", 2).alias("y"))


@query(GOOD + "SELECT vec_id, CAST(len(v) AS INTEGER) AS n, len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 AS valid, round(list_sum(v), 4) AS total FROM good")
def latent_scan_valid(t: Tables) -> DataFrame:
    """Vectors with their validity."""
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return vectors_of(t).select("vec_id", F.size("v").alias("n"), E.usable_vector(F.col("v")).alias("valid"), F.round(total, 4).alias("total"))


@query("SELECT vec_id, 'C' || label AS name FROM embeddings WHERE 'C' || label = 'C3'")
def cluster_select(t: Tables) -> DataFrame:
    """The bins of a cluster, by name."""
    meta = t.embeddings.select("label").distinct().withColumn("name", F.concat(F.lit("C"), "label"))
    return t.embeddings.join(meta, "label").where("name = 'C3'").select("vec_id", "name")


@query(GOOD + """, e AS (SELECT label, 1 + vec_id % 4 AS w, unnest(v) AS x, unnest(range(0, len(v))) AS place FROM good)
    SELECT label, CAST(place AS INTEGER) AS place, round(sum(w * x) / sum(w), 6) AS mean FROM e GROUP BY ALL""")
def patch_weighted_mean(t: Tables) -> DataFrame:
    """Means of patch vectors, weighted by mask pixels."""
    means = latents.weighted_mean(vectors_of(t).withColumn("w", 1 + F.col("vec_id") % 4), "label", "v", "w")
    return means.select("label", "place", F.round("mean", 6).alias("mean"))


@query(GOOD + """, a AS (SELECT vec_id, v, unnest(range(0, 360, 15)) AS angle FROM good), e AS (SELECT vec_id, angle, unnest(v) AS x, unnest(range(0, len(v))) AS place FROM a)
    SELECT vec_id AS frame, CAST(place AS INTEGER) AS place, round(avg(x * cos(radians(angle + place))), 6) + 0.0 AS mean FROM e GROUP BY ALL""")
def rotation_mean(t: Tables) -> DataFrame:
    """Means over 24 turned versions of a frame (turning stands for the feature model)."""
    turned = lambda v, angle: F.transform(v, lambda x, i: x * F.cos(F.radians(angle + i)))
    means = latents.rotation_mean(vectors_of(t).select(F.col("vec_id").alias("frame"), "v"), "v", turned)
    return means.select("frame", "place", (F.round("mean", 6) + 0.0).alias("mean"))


@query(GOOD + """, b AS (SELECT label AS video, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, v FROM good), w AS (SELECT video, frame // 3 AS bin, flatten(list(v ORDER BY frame)) AS v FROM b GROUP BY ALL HAVING count(*) = 3)
    SELECT video, CAST(bin AS BIGINT) AS bin, CAST(len(v) AS INTEGER) AS n, round(list_sum(v), 4) AS total, CASE WHEN len(list_filter(v, lambda x: isnan(x))) = 0 THEN 0 ELSE -1 END AS cluster FROM w""")
def window_concat(t: Tables) -> DataFrame:
    """Windows of three frames, joined, with their initial cluster."""
    from pyspark.sql import Window

    frames = vectors_of(t).select(F.col("label").alias("video"), "v", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long") - 1).alias("frame"))
    bins = latents.initial_clusters(timeline.windows(frames, 3, "v"), "v")
    return bins.select("video", "bin", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), "cluster")


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN label END AS label, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS part FROM embeddings")
def union_latents(t: Tables) -> DataFrame:
    """Batches of even and odd numbers joined by column name, so that every vector is in one; missing columns are null."""
    odd = F.coalesce(F.col("vec_id") % 2 != 0, F.lit(True))
    a, b = t.embeddings.where(~odd).select("vec_id", "label", F.lit("a").alias("part")), t.embeddings.where(odd).select("vec_id", F.lit("b").alias("part"))
    return a.unionByName(b, allowMissingColumns=True)


@query(GOOD + """, e AS (SELECT vec_id, label, unnest(v[1:4]) AS x, unnest(range(0, 4)) AS class FROM good), m AS (SELECT label, class, avg(1 / (1 + exp(-x * 4))) AS p FROM e GROUP BY ALL)
    SELECT label, CAST(arg_max(class, (p, -class)) AS INTEGER) AS class, round(max(p), 6) AS probability FROM m GROUP BY label""")
def prob_mean_argmax(t: Tables) -> DataFrame:
    """Mean class probabilities over variants, then the best class."""
    parts = vectors_of(t).select("label", F.posexplode(F.slice("v", 1, 4)).alias("class", "x")).select("label", "class", E.sigmoid(F.col("x") * 4).alias("probability"))
    return metrics.mean_probability_class(parts, "label").select("label", "class", F.round("probability", 6).alias("probability"))


@query(GOOD + """, l AS (SELECT vec_id // 5 AS pixel, v[1] * 8 AS logit FROM good), p AS (SELECT pixel, logit, least(greatest(1 / (1 + exp(-logit)), 1e-5), 1 - 1e-5) AS p FROM l),
    m AS (SELECT pixel, min(logit) AS least, exp(sum(ln(p))) AS q FROM p GROUP BY pixel)
    SELECT CAST(pixel AS BIGINT) AS pixel, round(least, 6) AS least, round(ln(least(greatest(q, 1e-5), 1 - 1e-5) / (1 - least(greatest(q, 1e-5), 1 - 1e-5))), 6) AS merged FROM m""")
def multi_engine_merge(t: Tables) -> DataFrame:
    """Background of several engines joined."""
    rows = vectors_of(t).select(F.expr("vec_id div 5").alias("pixel"), (F.element_at("v", 1) * 8).alias("logit"))
    return metrics.merge_engines(rows, "pixel").select("pixel", F.round("least", 6).alias("least"), F.round("merged", 6).alias("merged"))


@query(GOOD + "SELECT vec_id, round((v[1] - 0.05) * (v[1] - 0.05) + (v[2] - 0.02) * (v[2] - 0.02), 9) AS d2 FROM good ORDER BY (v[1] - 0.05) * (v[1] - 0.05) + (v[2] - 0.02) * (v[2] - 0.02), vec_id LIMIT 1")
def nearest_point(t: Tables) -> DataFrame:
    """The point nearest to a click."""
    d2 = graph.squared_distance([F.col("x"), F.col("y")], [F.lit(0.05), F.lit(0.02)])
    return points_of(t).select(F.col("id").alias("vec_id"), d2.alias("d2")).orderBy("d2", "vec_id").limit(1).select("vec_id", F.round("d2", 9).alias("d2"))


@query(GOOD + "SELECT round(((min(v[1]) + max(v[1])) / 2) - (max(v[1]) - min(v[1])) / 2 * 1.05, 6) AS low, round(((min(v[1]) + max(v[1])) / 2) + (max(v[1]) - min(v[1])) / 2 * 1.05, 6) AS high FROM good")
def embedding_extent(t: Tables) -> DataFrame:
    """The plotted range of an axis."""
    low, high = E.padded(F.min("x"), F.max("x"))
    return points_of(t).agg(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


NEAR = GOOD + """, p AS (SELECT vec_id AS id, v[1] AS x, v[2] AS y FROM good), pr AS (SELECT a.id AS a, b.id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON a.id < b.id
    AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.03 * 0.03)
"""


@query(NEAR + "SELECT a, b, round(d2, 9) AS d2 FROM pr")
def radius_neighbors(t: Tables) -> DataFrame:
    """Pairs within a radius."""
    return graph.within(points_of(t), ["x", "y"], 0.03).select("a", "b", F.round("d2", 9).alias("d2"))


@query(GOOD + """, d AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_reduce(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda s, x: s + x) AS d2 FROM good a JOIN good b ON a.vec_id <> b.vec_id)
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY d2, neighbour) AS INTEGER) AS rank, neighbour, round(d2, 6) AS d2 FROM d QUALIFY rank <= 5""")
def knn_graph(t: Tables) -> DataFrame:
    """The five nearest of each vector."""
    return graph.knn(vectors_of(t).select(F.col("vec_id").alias("id"), "v"), 5).select("id", F.col("rank").cast("int").alias("rank"), "neighbour", F.round("d2", 6).alias("d2"))


DBSCAN = "WITH RECURSIVE " + NEAR[5:] + """, sym AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr), core AS (SELECT id FROM p WHERE (SELECT count(*) FROM sym WHERE a = id) + 1 >= 5),
    e AS (SELECT a, b FROM sym WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), reach AS (SELECT id AS n, id AS c FROM core UNION SELECT e.b, r.c FROM reach r JOIN e ON e.a = r.n AND r.c < e.b),
    root AS (SELECT n AS id, min(c) AS root FROM reach GROUP BY n), num AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM root),
    clus AS (SELECT p.id, CAST(coalesce(num.cluster, (SELECT min(n2.cluster) FROM sym s JOIN num n2 ON n2.id = s.b WHERE s.a = p.id), -1) AS INTEGER) AS cluster FROM p LEFT JOIN num USING (id))
"""


@query(DBSCAN + "SELECT id, cluster FROM clus")
def dbscan_cluster(t: Tables) -> DataFrame:
    """Density clusters of two elements."""
    return graph.dbscan(points_of(t), ["x", "y"], 0.03)


@query("""WITH c AS (SELECT vec_id AS bin, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE 0 END AS cluster, label FROM embeddings)
    SELECT bin, CAST(CASE WHEN cluster = 0 AND label IN (2, 5, 7) THEN CASE label WHEN 2 THEN 1 WHEN 5 THEN 2 ELSE 3 END ELSE cluster END AS INTEGER) AS cluster FROM c""")
def hierarchical_relabel(t: Tables) -> DataFrame:
    """Named local clusters taken into the global labelling."""
    current = t.embeddings.select(F.col("vec_id").alias("bin"), F.when(F.col("vec_id") % 10 == 0, -1).otherwise(0).alias("cluster"), "label")
    local = current.where("cluster = 0").select("bin", F.col("label").alias("cluster"))
    names = t.spark.createDataFrame([(2, "rear"), (5, "walk"), (7, "groom")], "cluster int, name string")
    return latents.imported(current.select("bin", "cluster"), local, names)


@query("SELECT CASE WHEN label IN (3, 6, 8) THEN 3 ELSE label END AS cluster, CAST(count(*) AS BIGINT) AS n FROM embeddings GROUP BY 1")
def cluster_merge(t: Tables) -> DataFrame:
    """Clusters joined into the least of them."""
    return latents.merged(t.embeddings.select(F.col("label").alias("cluster")), [6, 3, 8]).groupBy("cluster").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT DISTINCT label AS id FROM embeddings UNION SELECT -1) SELECT CAST(id AS INTEGER) AS "Id", CASE WHEN id < 0 THEN 'invalid' ELSE 'C' || id END AS "Name",
    CASE WHEN id < 0 THEN '#808080' ELSE ['#1b9e77', '#d95f02', '#7570b3', '#e7298a'][id % 4 + 1] END AS color,
    CAST(CASE WHEN id < 0 THEN 128 ELSE [27, 217, 117, 231][id % 4 + 1] END AS INTEGER) AS red FROM c""")
def cluster_meta_export(t: Tables) -> DataFrame:
    """Ids, names and colours of clusters."""
    ids = t.embeddings.select(F.col("label").alias("Id")).union(t.spark.createDataFrame([(-1,)], "Id int")).distinct()
    color = latents.palette_color(F.col("Id"), COLORS)
    named = ids.select("Id", F.when(F.col("Id") < 0, "invalid").otherwise(F.concat(F.lit("C"), "Id")).alias("Name"), color.alias("color"))
    return named.withColumn("red", E.hex_channel(F.col("color"), 0))


@query()
def pca_embedding(t: Tables) -> DataFrame:
    """Coordinates on the two main axes."""
    rows = vectors_of(t)
    return latents.projected(rows, "vec_id", "v", *latents.principal_axes(rows, "v", 2))


#: At most so many points are laid out on the driver; the others are placed by their neighbours.
LANDMARKS = 2_000


def usable_of(t: Tables) -> DataFrame:
    """id, v of all usable vectors."""
    return vectors_of(t).select(F.col("vec_id").alias("id"), "v").where(F.col("id").isNotNull() & E.usable_vector(F.col("v")))


def _folder(t: Tables) -> str:
    return f"{checkpointing(t.spark).sparkContext._jsc.sc().getCheckpointDir().get()}/chain-{uuid.uuid4().hex}"


@query()
def umap_embedding(t: Tables) -> DataFrame:
    """A layout of the landmarks' fuzzy neighbour graph from its spectral start, and all other vectors placed by their nearest landmarks."""
    return manifold.fit_chain(usable_of(t), [manifold.Stage(landmarks=LANDMARKS)], _folder(t))


@query()
def embedding_chain(t: Tables) -> DataFrame:
    """Two stages: five axes first, then two from these."""
    stages = [manifold.Stage(n_components=5, n_epochs=100, start="pca", landmarks=LANDMARKS), manifold.Stage(min_dist=0.0, landmarks=LANDMARKS)]
    return manifold.fit_chain(usable_of(t), stages, _folder(t))


@query()
def embedding_transform(t: Tables) -> DataFrame:
    """All vectors once more, as new data, by a chain that was fitted on them and read back."""
    rows, path = usable_of(t), _folder(t)
    manifold.fit_chain(rows, [manifold.Stage(landmarks=LANDMARKS)], path)
    return manifold.transform_chain(t.spark, rows, path)
