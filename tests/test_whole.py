"""Operators give a row for every row they are asked about, on tables beyond their bounds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethogrid.plans import embeddings, relations
from ethogrid.plans.catalogue import QUERIES


@pytest.mark.parametrize("name", ["embedding_transform", "umap_embedding"])
def test_more_vectors_than_landmarks(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(embeddings, "LANDMARKS", 20)
    x = np.random.default_rng(3).normal(size=(300, 4))
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame([*rows, (900, 0, [float("nan")] * 4), (901, 0, None)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.id: r.e for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(300))
    assert all(len(e) == 2 and np.isfinite(e).all() for e in got.values())


def test_placing_equals_brute_force(spark):
    import pandas as pd

    from ethogrid.operators import latents

    rng = np.random.default_rng(4)
    x, e = rng.normal(size=(150, 3)), rng.normal(size=(40, 2))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    marks = pd.DataFrame({"id": range(40), "v": list(x[:40]), "e": list(e)})
    own = {r.id: r.e for r in latents.transformed(rows, marks, 5).collect()}
    fixed = {r.id: r.e for r in latents.transformed(rows, marks, 5, fixed=True).collect()}
    for i in range(150):
        d = np.sqrt(((x[:40] - x[i]) ** 2).sum(axis=1))
        if i < 40:
            d[i] = np.inf
        near = np.argsort(d)[:5]
        w = 1 / (d[near] + 1e-9)
        wanted = (w[:, None] * e[near]).sum(axis=0) / w.sum()
        assert np.allclose(own[i], wanted)
        assert np.allclose(fixed[i], e[i] if i < 40 else wanted)


def test_suppression_of_every_image_equals_brute_force(spark, tmp_path, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey % 2000 between 250 and 1400 and l_orderkey % 2 = 0").withColumn("l_orderkey", (F.col("l_orderkey") / 100).cast("long") * 100)
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    groups, wanted = {}, []
    for r in rows.collect():
        x, y = r.l_partkey % 64, r.l_suppkey % 48
        box = (x, y, x + 4 + int(r.l_quantity) % 24, y + 4 + 3 * r.l_linenumber)
        groups.setdefault(r.l_orderkey % 2000, []).append(((-r.l_extendedprice, *[r[c] for c in relations.TIE[1:]]), box))
    for g, listed in groups.items():
        kept = []
        for _, b in sorted(listed):
            shared = [max(min(b[2], k[2]) - max(b[0], k[0]), 0) * max(min(b[3], k[3]) - max(b[1], k[1]), 0) for k in kept]
            size = lambda z: (z[2] - z[0]) * (z[3] - z[1])
            if not any(10 * i > 3 * (size(k) + size(b) - i) for i, k in zip(shared, kept, strict=True)):
                kept.append(b)
        wanted += [(g, *b) for b in kept]
    got = sorted(tuple(r) for r in QUERIES["box_nms"](spark, str(tmp_path)).collect())
    assert got == sorted(wanted) and 0 < len(wanted) < rows.count() and max(groups) >= 300


def test_every_vector_is_in_a_batch(spark, sf_dir):
    ids = sorted(r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    rows = QUERIES["union_latents"](spark, sf_dir).collect()
    assert sorted(r.vec_id for r in rows) == ids and {(r.part, r.vec_id % 2, r.label is None) for r in rows} == {("a", 0, False), ("b", 1, True)}


def test_level_points_have_an_angle(spark, tmp_path):
    points = [(40, 24, -90.0), (20, 24, 90.0), (32, 24, -90.0), (32, 30, 0.0), (32, 20, -180.0)]
    rows = [(k, 1, x, y) for k, (x, y, _) in enumerate(points)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.l_orderkey: r.angle for r in QUERIES["tail_angle"](spark, str(tmp_path)).collect()} == {k: a for k, (_, _, a) in enumerate(points)}
