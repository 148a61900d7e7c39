"""Embedding chains: spectral starts, layouts of landmarks, and fitted stages kept as tables.

A stage takes vectors, lays out a bounded number of landmarks by their fuzzy neighbour graph, and places every
vector by its nearest landmarks; a chain feeds each stage with the coordinates of the one before. Fitted stages are written to a
folder and read back to transform other data.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethogrid import functions as E
from ethogrid.operators import graph, latents
from ethogrid.session import cut


@dataclass(frozen=True)
class Stage:
    """A step of a chain. start: 'spectral' or 'pca'. Every vector is placed by `place` landmarks, of which there are `landmarks` at
    most; they are the vectors whose hash comes first, so the same ones whatever the order of rows."""

    n_neighbors: int = 15
    n_components: int = 2
    min_dist: float = 0.1
    spread: float = 1.0
    n_epochs: int = 200
    start: str = "spectral"
    landmarks: int = 2000
    place: int = 16


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b), the least-squares fit to a share that is 1 up to min_dist and then falls off by spread."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p, damp = np.zeros(2), 1e-2  # ln a and ln b

    def miss(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.exp(p)
        power = a * x ** (2 * b)
        f = 1 / (1 + power)
        slope = -(f**2) * power
        return f - y, np.stack([slope, slope * 2 * b * np.log(x)], axis=1)

    error, slopes = miss(p)
    for _ in range(200):
        square = slopes.T @ slopes
        step = np.linalg.solve(square + damp * np.diag(np.diag(square)), -slopes.T @ error)
        tried, tried_slopes = miss(p + step)
        if tried @ tried < error @ error:
            p, error, slopes, damp = p + step, tried, tried_slopes, damp / 3
            if np.abs(step).max() < 1e-12:
                break
        else:
            damp *= 4
    a, b = np.exp(p)
    return float(a), float(b)


def products(rows: DataFrame, column: str, size: int) -> np.ndarray:
    """The sum over rows of the outer product of a vector with itself; size squared numbers reach the driver, whatever the rows."""

    def partial(batches):
        total = np.zeros((size, size))
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, size))
            total += x.T @ x
        yield pd.DataFrame({"total": [total.ravel().tolist()]})

    parts = rows.select(F.col(column).alias("x")).mapInPandas(partial, "total array<double>")
    sums = parts.select(F.posexplode("total").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()
    return sums["v"].to_numpy().reshape(size, size) if len(sums) else np.zeros((size, size))


def _combined(vector: str, weights: np.ndarray) -> F.Column:
    """The vector's products with the columns of weights."""
    dot = lambda w: F.aggregate(F.zip_with(vector, F.lit(w.tolist()), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.array(*[dot(w) for w in weights.T])


def spectral(edges: DataFrame, k: int, tolerance: float = 1e-4, cycles: int = 12, degree: int = 8, spare: int = 3) -> DataFrame:
    """id, e: the k leading eigenvectors, but for the constant one, of the normalised graph; edges (a, b, w) hold both directions.

    The matrix is D^-1/2 W D^-1/2. From a block of k + spare vectors a cycle takes `degree` products with the matrix
    (a join and a sum each, by Chebyshev's recurrence, so that the vectors stay apart), and solves the problem within their
    span; only sums as large as the span squared reach the driver. The best vectors begin the next cycle, until their residuals
    are below the tolerance or the cycles are used up. Vectors have length 1; the largest element is positive. A node
    without edges isn't in the graph. With several components the leading vectors tell them apart.
    """
    m = k + spare
    ends = edges.where("w > 0").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("w").cast("double").alias("w"))
    degrees = cut(ends.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("d")))
    scaled = ends.join(degrees.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degrees.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    matrix = cut(scaled.select("a", "b", (F.col("w") / F.sqrt(F.col("da") * F.col("db"))).alias("s")))
    n, total = degrees.agg(F.count("*"), F.sum("d")).first()
    constant = F.sqrt(F.col("d") / F.lit(total or 1.0))
    draw = lambda j: E.seeded(F.col("id") * 131 + j + 1, 1 << 30) / float(1 << 29) - 1
    block = degrees.select("id", constant.alias("one"), F.array(*[draw(j) for j in range(m)]).alias("x"))
    if not n:
        return block.select("id", F.array().cast("array<double>").alias("e"))

    def times(rows: DataFrame, column: str) -> DataFrame:
        """id and y: the matrix times a block of vectors."""
        met = matrix.join(rows.select(F.col("id").alias("b"), column), "b")
        sums = met.groupBy(F.col("a").alias("id")).agg(*[F.sum(F.col("s") * F.col(column)[j]).alias(f"y{j}") for j in range(m)])
        return sums.select("id", F.array(*[f"y{j}" for j in range(m)]).alias("y"))

    span = (degree + 1) * m
    for _ in range(cycles):
        rows = cut(block.join(times(block, "x"), "id").select("id", "one", F.col("x").alias("before"), F.col("y").alias("now"), F.concat(F.array("one"), "x", "y").alias("basis")))
        for _ in range(degree):
            twice = F.zip_with("y", "before", lambda y, x: 2 * y - x)
            rows = cut(rows.join(times(rows, "now"), "id").select("id", "one", F.col("now").alias("before"), twice.alias("now"), F.concat("basis", twice).alias("basis")))
        gram = products(rows, "basis", 1 + (degree + 2) * m)
        # the matrix times T_j is half of T_(j+1) and T_(j-1), times T_0 it is T_1; the last block serves for this alone
        inside, to = slice(1, 1 + span), np.zeros((1 + (degree + 2) * m, span))
        for j in range(degree + 1):
            for i in range(m):
                above = 1 + (j + 1) * m + i
                to[above, j * m + i] = 1.0 if j == 0 else 0.5
                if j:
                    to[1 + (j - 1) * m + i, j * m + i] += 0.5
        image, own = gram[inside] @ to, gram[inside, inside]
        squared = to.T @ gram @ to
        along, ones = gram[0, inside], gram[0, 0]
        own, image, squared = (own - np.outer(along, along) / ones, image - np.outer(along, along) / ones, squared - np.outer(along, along) / ones)  # without the constant vector, of value 1
        size, axes = np.linalg.eigh((own + own.T) / 2)
        good = size > size.max(initial=0) * 1e-12
        white = axes[:, good] / np.sqrt(size[good])
        values, mix = np.linalg.eigh(white.T @ (image + image.T) / 2 @ white)
        best = np.argsort(-values)[:m]
        coefficients = white @ mix[:, best]
        residual = np.sqrt(np.maximum(np.diag(coefficients.T @ squared @ coefficients) - values[best] ** 2, 0))
        if coefficients.shape[1] < m:  # a graph of few nodes: the rest of the block stays zero
            coefficients = np.pad(coefficients, ((0, 0), (0, m - coefficients.shape[1])))
        # the vectors' share of the constant one goes
        weights = np.concatenate([-(along @ coefficients)[None, :] / ones, coefficients, np.zeros((m, m))])
        block = cut(rows.select("id", "one", _combined("basis", weights).alias("x")))
        if (residual[:k] < tolerance).all():
            break
    found = block.select("id", F.slice("x", 1, k).alias("e"))
    top = found.agg(*[F.max_by(F.col("e")[j], F.struct(F.abs(F.col("e")[j]), -F.col("id"))).alias(f"t{j}") for j in range(k)]).first()
    signs = np.diag([-1.0 if (t or 0) < 0 else 1.0 for t in top])
    return found.select("id", _combined("e", signs).alias("e"))


def landmarks(rows: DataFrame, most: int, key: str = "id") -> DataFrame:
    """The rows whose hash comes first."""
    return rows.orderBy(E.seeded(F.col(key) + 1, 1 << 30), key).limit(most)


def fit(rows: DataFrame, stage: Stage) -> pd.DataFrame:
    """id, v, e of the landmarks of rows (id, v), laid out; stage.landmarks of them at most are on the driver."""
    marks = cut(landmarks(rows, stage.landmarks))
    edges = cut(latents.fuzzy_weights(graph.knn(marks, stage.n_neighbors)))
    found = marks.toPandas()
    if stage.start == "spectral":
        begun = spectral(edges, stage.n_components).toPandas().set_index("id")["e"].to_dict()
        y = np.array([begun.get(i, [0.0] * stage.n_components) for i in found["id"]])
    elif stage.start == "pca":
        mean, axes = latents.principal_axes(varied(marks), "v", stage.n_components)
        y = (np.stack(varied(marks).toPandas()["v"].to_numpy()) - mean) @ axes.T
    else:
        raise ValueError(f"no such start: {stage.start!r}")
    place = {i: k for k, i in enumerate(found["id"])}
    links = edges.toPandas()
    links["a"], links["b"] = links["a"].map(place), links["b"].map(place)
    noise = np.random.default_rng(5).normal(scale=1e-4, size=y.shape)  # points that begin alike come apart
    a, b = curve(stage.min_dist, stage.spread)
    done = latents.layout(links, y / max(np.abs(y).max(initial=0), 1e-9) * 10 + noise, epochs=stage.n_epochs, a=a, b=b)
    return found.assign(e=list(done))


def varied(rows: DataFrame) -> DataFrame:
    """rows with v cut to the elements that vary most, one fewer than there are rows."""
    keep = [r.place for r in latents.most_variable(rows, "v").orderBy("place").collect()]  # as many as a vector has elements
    return rows.select("id", F.array(*[F.col("v")[p] for p in keep]).alias("v"))


def fit_chain(rows: DataFrame, stages: Sequence[Stage], path: str) -> DataFrame:
    """id and e of every row (id, v) after all stages; the fitted stages are written below the path, each before the next begins."""
    spark = rows.sparkSession
    if not stages:
        raise ValueError("a chain has a stage at least")
    for k, stage in enumerate(stages):
        marks = fit(rows, stage)
        spark.createDataFrame([(json.dumps(asdict(stage)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{k:03d}/stage")
        table = spark.createDataFrame([(int(i), list(map(float, v)), list(map(float, e))) for i, v, e in zip(marks["id"], marks["v"], marks["e"], strict=True)], "id long, v array<double>, e array<double>")
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/{k:03d}/landmarks")
        placed = latents.transformed(rows, marks, stage.place, fixed=True)
        rows = cut(placed.select("id", F.col("e").alias("v")))
    spark.createDataFrame([(len(stages),)], "stages int").coalesce(1).write.mode("overwrite").json(f"{path}/chain")
    return rows.select("id", F.col("v").alias("e"))


def transform_chain(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """id and e of other rows (id, v) by the stages written below the path, in their order. Rows with the id of a landmark are
    placed like any other."""
    n = spark.read.schema("stages int").json(f"{path}/chain").first()[0]
    for k in range(n):
        stage = Stage(**json.loads(spark.read.text(f"{path}/{k:03d}/stage").first()[0]))
        marks = spark.read.parquet(f"{path}/{k:03d}/landmarks").toPandas()  # stage.landmarks rows at most
        ids = marks["id"].to_numpy()
        marks = marks.assign(id=np.arange(len(ids)))
        shifted = rows.select((-1 - F.col("id")).alias("id"), "v")  # below every landmark's number, so that none is taken for a landmark
        rows = latents.transformed(shifted, marks, stage.place).select((-1 - F.col("id")).alias("id"), F.col("e").alias("v"))
    return rows.select("id", F.col("v").alias("e"))
