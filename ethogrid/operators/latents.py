"""Latent vectors: weighted means, validity, embeddings, and relabelling of clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethogrid import functions as E


def weighted_mean(rows: DataFrame, by: str, vector: str, weight: str) -> DataFrame:
    """by, place, mean: the weighted mean of each element over a group's vectors."""
    parts = rows.select(by, F.col(weight).cast("double").alias("w"), F.posexplode(vector).alias("place", "v"))
    return parts.groupBy(by, "place").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"))


def rotation_mean(rows: DataFrame, vector: str, turned, step: int = 15) -> DataFrame:
    """frame, place, mean over the angles 0, step, ... 345; turned(vector, angle) gives the vector at an angle."""
    angles = rows.select("frame", vector, F.explode(F.sequence(F.lit(0), F.lit(345), F.lit(step))).alias("angle"))
    parts = angles.select("frame", F.posexplode(turned(F.col(vector), F.col("angle"))).alias("place", "v"))
    return parts.groupBy("frame", "place").agg(F.avg("v").alias("mean"))


def initial_clusters(bins: DataFrame, vector: str) -> DataFrame:
    """bins with cluster 0 where the vector is usable, else -1."""
    return bins.withColumn("cluster", F.when(E.usable_vector(F.col(vector)), 0).otherwise(-1))


def imported(current: DataFrame, local: DataFrame, names: DataFrame) -> DataFrame:
    """current (bin, cluster) after a local labelling (bin, cluster) with names (cluster, name): each named local
    cluster gets the next free number, in the order of their labels; other bins keep theirs."""
    top = current.agg(F.max("cluster").alias("top"))
    order = Window.partitionBy(F.lit(0)).orderBy("cluster")
    fresh = names.select("cluster", F.row_number().over(order).alias("k")).crossJoin(F.broadcast(top)).select("cluster", (F.col("top") + F.col("k")).alias("new"))
    moved = local.join(fresh, "cluster").select("bin", "new")
    return current.join(moved, "bin", "left").select("bin", F.coalesce("new", "cluster").cast("int").alias("cluster"))


def merged(rows: DataFrame, clusters: list[int], into: str = "least") -> DataFrame:
    """rows with some clusters joined: into the least of them, or the first named."""
    goal = min(clusters) if into == "least" else clusters[0]
    return rows.withColumn("cluster", F.when(F.col("cluster").isin(clusters), F.lit(goal)).otherwise(F.col("cluster")))


def palette_color(cluster: Column, colors: list[str], grey: str = "#808080") -> Column:
    listed = F.array(*[F.lit(c) for c in colors])
    return F.when(cluster < 0, F.lit(grey)).otherwise(F.element_at(listed, (cluster % len(colors) + 1).cast("int")))


def principal_axes(rows: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, k axes) by the covariance matrix: sums of pairwise products, as large as the dimension squared."""
    n = rows.select(F.size(vector)).first()
    dims = n[0] if n else 0
    wide = rows.select(*[F.element_at(vector, i + 1).cast("double").alias(f"v{i}") for i in range(dims)])

    def partial(batches):
        total, products, count = np.zeros(dims), np.zeros((dims, dims)), 0
        for batch in batches:
            x = batch.to_numpy()
            total, products, count = total + x.sum(axis=0), products + x.T @ x, count + len(x)
        yield pd.DataFrame({"n": [count], "total": [total.tolist()], "products": [products.ravel().tolist()]})

    parts = wide.mapInPandas(partial, "n long, total array<double>, products array<double>")
    # one small row a task, added up element by element before anything reaches the driver
    sums = parts.select(F.posexplode(F.concat(F.array(F.col("n").cast("double")), "total", "products")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    count, mean = sums[0], sums[1 : 1 + dims] / sums[0]
    covariance = sums[1 + dims :].reshape(dims, dims) / count - np.outer(mean, mean)
    values, axes = np.linalg.eigh(covariance)
    axes = axes[:, np.argsort(-values)[:k]].T
    return mean, axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]


def projected(rows: DataFrame, key: str, vector: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """key and e: the coordinates on the axes, in the JVM."""
    centred = F.zip_with(vector, F.lit(mean.tolist()), lambda x, m: x - m)
    dot = lambda axis: F.aggregate(F.zip_with(centred, F.lit(axis.tolist()), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x)
    return rows.select(key, F.array(*[dot(a) for a in axes]).alias("e"))


def fuzzy_weights(near: DataFrame, key: str = "id") -> DataFrame:
    """a, b, w of the symmetric fuzzy graph over kNN rows (key, rank, neighbour, d2).

    For each point rho is its nearest distance and sigma is found by bisection so that its weights sum
    to log2(k); then w = x + y - x y of both directions.
    """

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.sqrt(pdf.sort_values("rank")["d2"].to_numpy())
        rho, goal, low, high = (d[d > 0].min() if (d > 0).any() else 0.0), np.log2(max(len(d), 2)), 0.0, np.inf
        sigma = 1.0
        for _ in range(64):
            total = np.exp(-np.maximum(d - rho, 0) / sigma).sum()
            if abs(total - goal) < 1e-5:
                break
            if total > goal:
                high, sigma = sigma, (low + sigma) / 2
            else:
                low, sigma = sigma, sigma * 2 if np.isinf(high) else (sigma + high) / 2
        pdf = pdf.sort_values("rank")
        return pd.DataFrame({"a": pdf[key], "b": pdf["neighbour"], "w": np.exp(-np.maximum(d - rho, 0) / max(sigma, 1e-3 * d.mean() + 1e-12))})

    one = near.groupBy(key).applyInPandas(smooth, "a long, b long, w double")
    other = one.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("w").alias("v"))
    x, y = F.coalesce("w", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    return one.join(other, ["a", "b"], "full").select("a", "b", (x + y - x * y).alias("w"))


def layout(edges: pd.DataFrame, start: np.ndarray, epochs: int = 200, rate: float = 1.0, negatives: int = 5, a: float = 1.577, b: float = 0.895) -> np.ndarray:
    """A stochastic layout of a bounded sample: edges attract by weight, random points repel; seeded."""
    rng, y = np.random.default_rng(11), start.astype(float).copy()
    src, dst, w = edges["a"].to_numpy(), edges["b"].to_numpy(), edges["w"].to_numpy() / max(edges["w"].max(), 1e-12)
    for epoch in range(epochs):
        alpha = rate * (1 - epoch / epochs)
        pick = rng.random(len(w)) < w
        i, j = src[pick], dst[pick]
        delta = y[i] - y[j]
        d2 = (delta * delta).sum(axis=1)
        pull = np.clip((-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b))[:, None] * delta, -4, 4) if len(i) else delta
        pull = np.where(d2[:, None] > 0, pull, 0)
        np.add.at(y, i, alpha * pull)
        np.add.at(y, j, -alpha * pull)
        for _ in range(negatives):
            k = rng.integers(0, len(y), len(i))
            delta = y[i] - y[k]
            d2 = (delta * delta).sum(axis=1)
            np.add.at(y, i, alpha * np.clip((2 * b / ((0.001 + d2) * (1 + a * d2**b)))[:, None] * delta, -4, 4))
    return y


def transformed(rows: DataFrame, marks: pd.DataFrame, k: int, key: str = "id", vector: str = "v", fixed: bool = False) -> DataFrame:
    """key and e of every row: the coordinates of its k nearest landmarks, weighted by inverse distance.

    marks has key, vector and e of a bounded number of landmarks. A row meets all of them, in blocks, and is not
    its own neighbour unless no other landmark is there; ties go to the smaller key. With `fixed`, landmarks keep
    their own e.
    """
    marks = marks.sort_values(key, kind="stable")
    ids, v, e = marks[key].to_numpy(np.int64), np.stack(marks[vector].to_numpy()).astype(float), np.stack(marks["e"].to_numpy()).astype(float)

    def place(own: np.ndarray, x: np.ndarray) -> np.ndarray:
        d2 = np.zeros((len(x), len(ids)))
        for j in range(v.shape[1]):
            step = x[:, j, None] - v[None, :, j]
            d2 += step * step
        same = own[:, None] == ids
        if len(ids) > 1:
            d2[same] = np.inf
        near = np.argsort(d2, axis=1, kind="stable")[:, :k]
        w = 1 / (np.sqrt(np.take_along_axis(d2, near, axis=1)) + 1e-9)
        out = (w[:, :, None] * e[near]).sum(axis=1) / w.sum(axis=1)[:, None]
        return np.where(same.any(axis=1)[:, None], e[same.argmax(axis=1)], out) if fixed else out

    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), 64):
                part = batch.iloc[low : low + 64]
                out = place(part["key"].to_numpy(np.int64), np.stack(part["v"].to_numpy()).astype(float))
                yield pd.DataFrame({key: part["key"].to_numpy(np.int64), "e": list(out)})

    return rows.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v")).mapInPandas(run, f"{key} long, e array<double>")


def most_variable(rows: DataFrame, vector: str, most: int | None = None) -> DataFrame:
    """place and variance of the elements that vary most: as many as there are rows less one, or `most`; ties to the smaller place."""
    spread = rows.select(F.posexplode(vector).alias("place", "x")).groupBy("place").agg(F.var_pop("x").alias("variance"), F.count("*").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("variance"), "place")  # one row for each element of a vector
    ranked = spread.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= (F.lit(most) if most else F.col("n") - 1)).select("place", "variance", F.col("rank").cast("int").alias("rank"))


def cleared(clusters: DataFrame) -> DataFrame:
    """Every bin back in the first cluster, but for those without vectors."""
    return clusters.withColumn("cluster", F.when(F.col("cluster") == -1, -1).otherwise(0))


def split(current: DataFrame, local: DataFrame, focus: int, meta: DataFrame, colors: list[str]) -> tuple[DataFrame, DataFrame]:
    """(bin, cluster; cluster, name, color) after a cluster is split into its local clusters, in the order of their numbers.

    current and local have bin and cluster; only bins of the focus count in local, and its noise (-1) keeps the parent. meta has
    cluster, name and color of every cluster that was ever named: numbers go on from there, not from those still in use, so
    that none is given twice. A new cluster is called C and its number; its color is that of its local number among
    the colors that meta doesn't use (among all of them, if it uses all).
    """
    inside = local.join(current.where(F.col("cluster") == focus).select("bin"), "bin", "left_semi")
    parts = inside.where("cluster >= 0").select("cluster").distinct().withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cluster")))  # a row a cluster
    known = meta.agg(F.max("cluster").alias("top"), F.collect_set("color").alias("used"))  # one row
    free = F.array_except(F.array(*map(F.lit, colors)), "used")
    free = F.when(F.size(free) > 0, free).otherwise(F.array(*map(F.lit, colors)))
    fresh = parts.join(known.hint("broadcast")).select(
        "cluster", (F.coalesce("top", F.lit(-1)) + F.col("place")).cast("int").alias("new"), F.element_at(free, (F.col("cluster") % F.size(free) + 1).cast("int")).alias("color")
    )
    named = inside.join(fresh, "cluster").select("bin", "new")
    bins = current.join(named, "bin", "left").select("bin", F.coalesce("new", "cluster").cast("int").alias("cluster"))
    added = fresh.select(F.col("new").alias("cluster"), F.concat(F.lit("C"), "new").alias("name"), "color")
    return bins, meta.select("cluster", "name", "color").unionByName(added)


def renamed(meta: DataFrame, cluster: int, name: str) -> DataFrame:
    """meta (cluster, name) with a cluster's name changed; a name that another cluster has, or an empty one, is refused."""
    if not name or not meta.where((F.col("name") == name) & (F.col("cluster") != cluster)).isEmpty():
        raise ValueError(f"name is empty or in use: {name!r}")
    return meta.withColumn("name", F.when(F.col("cluster") == cluster, F.lit(name)).otherwise(F.col("name")))
