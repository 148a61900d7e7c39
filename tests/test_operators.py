"""Hand-made cases of the operators."""

from __future__ import annotations

import re
import time

import numpy as np
from pyspark.sql import functions as F

from ethogrid import functions as E
from ethogrid.operators import boxes, graph, kinematics, latents, masks, metrics, sequences, timeline


def runs(spark, grid: list[str], frame: int = 0):
    """Runs of a drawing: digits are ROIs, dots background."""
    rows = [(frame, int(c), y, x) for y, line in enumerate(grid) for x, c in enumerate(line) if c != "."]
    return masks.runs_of(spark.createDataFrame(rows, "frame long, roi long, y long, x long"))


def pixels(df) -> set:
    return {(r.roi, r.y, r.x) for r in masks.pixels_of(df).collect()}


def test_diagonal_touch_is_one_component(spark):
    parts = masks.part_sizes(masks.components_of(runs(spark, ["11....", "11....", "..1...", "...11."]))).collect()
    assert [(r.component, r.area) for r in parts] == [(1, 7)]


def test_largest_component_and_tie(spark):
    one = masks.largest(masks.part_sizes(masks.components_of(runs(spark, ["111...", "11..11", "....1."])))).first()
    assert (one.area, round(one.x, 2), round(one.y, 2)) == (5, 0.8, 0.4)
    tie = masks.largest(masks.part_sizes(masks.components_of(runs(spark, ["11..11", "11..11"])))).first()
    assert (tie.component, tie.area, tie.x) == (1, 4, 0.5)


def test_centroid_rounds_half_to_even(spark):
    rows = masks.pixels_of(runs(spark, ["..11.."]))
    assert kinematics.areas(rows).first()["x"] == 2


def test_dense_range_keeps_missing_frames(spark):
    videos = spark.createDataFrame([("a", 4), ("b", 0)], "video string, total_frames long")
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 9, 1.0)], "video string, frame long, x double")
    assert [(r.frame, r.x) for r in kinematics.dense(videos, rows).orderBy("frame").collect()] == [(0, None), (1, 5.0), (2, None), (3, None)]


def test_rle_first_pixel_and_order(spark):
    first = masks.encode(masks.pixels_of(runs(spark, ["1.", ".."])), 2, 2).first()
    assert first.counts == [0, 1, 3]
    below = masks.encode(masks.pixels_of(runs(spark, ["..", "1."])), 2, 2)
    assert below.first().counts == [1, 1, 2]
    assert [(r.y, r.x) for r in masks.decode(below, 2).collect()] == [(1, 0)]
    full = masks.encode(masks.pixels_of(runs(spark, ["11", "11"])), 2, 2)
    assert full.first().counts == [0, 4]
    assert full.select(masks.encoded_area(F.col("counts")).alias("a")).first().a == 4


def test_small_regions(spark):
    grid = ["111111", "1.1..1", "111..1", "111111", "......", ".1...."]
    done = masks.clean(runs(spark, grid), 6, 6, 3)
    assert pixels(done) == {(1, y, x) for y, line in enumerate(grid[:4]) for x, c in enumerate(line) if c == "1" or (y, x) == (1, 1)}
    assert {r.score for r in done.collect()} == {0}
    tiny = masks.clean(runs(spark, ["1.....", "......", "..11.."]), 3, 6, 5)
    assert pixels(tiny) == {(1, 2, 2), (1, 2, 3)}


def test_windows_drop_the_tail_and_mark_nan(spark):
    rows = [("v", f, [float(f), float("nan") if f == 4 else 1.0]) for f in range(7)]
    bins = latents.initial_clusters(timeline.windows(spark.createDataFrame(rows, "video string, frame long, latent array<double>"), 3), "latent")
    assert [(r.bin, len(r.latent), r.cluster) for r in bins.orderBy("bin").collect()] == [(0, 6, 0), (1, 6, -1)]


def test_runs_with_a_short_and_a_null_label(spark):
    rows = [("v", 0, "A"), ("v", 1, "B"), ("v", 2, "B"), ("v", 3, None), ("w", 0, "B")]
    spans = timeline.runs(spark.createDataFrame(rows, "video string, frame long, label string"))
    assert sorted((r.video, r.run, str(r.label), r.start, r.end) for r in spans.collect()) == [("v", 1, "A", 0, 0), ("v", 2, "B", 1, 2), ("v", 3, "None", 3, 3), ("w", 1, "B", 0, 0)]
    text = timeline.srt(timeline.cues(spans.where("video = 'v'"), 10)).first().text
    assert text.startswith("1\n00:00:00,000 --> 00:00:00,000\nA\n\n2\n00:00:00,100 --> 00:00:00,200\nB\n") and "invalid" in text


def test_dbscan_border_joins_the_lower_cluster(spark):
    left = [(i, 0.1 * i, 0.0) for i in range(5)]
    right = [(10 + i, 1.0 + 0.1 * i, 0.0) for i in range(5)]
    points = spark.createDataFrame([*left, *right, (20, 0.7, 0.0), (30, 9.0, 9.0)], "id long, x double, y double")
    got = {r.id: r.cluster for r in graph.dbscan(points, ["x", "y"], 0.31, 5).collect()}
    assert [got[i] for i in (0, 4, 10, 14, 20, 30)] == [0, 0, 1, 1, 0, -1]


def test_suppression_chain(spark):
    rows = [(0, 0, 0, 10, 10, 3), (0, 5, 0, 15, 10, 2), (0, 10, 0, 20, 10, 1)]
    kept = boxes.suppress(spark.createDataFrame(rows, "g long, x0 long, y0 long, x1 long, y1 long, s long"), "g", [-F.col("s"), F.col("x0")]).collect()
    assert sorted(r.x0 for r in kept) == [0, 10]


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)).round(3)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    got = {(r.id, r["rank"]): r.neighbour for r in graph.knn(df, 4, block=20).collect()}
    for i in range(60):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert [got[i, k + 1] for k in range(4)] == np.lexsort((np.arange(60), d))[:4].tolist()


def test_knn_in_rounds_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 2, size=(40, 3)), rng.normal(size=(10, 3)), 1e200 * rng.normal(size=(6, 3)), [[np.nan, 0, 0], [0, np.inf, 0]], 1e-30 * rng.normal(size=(2, 3))])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    got = {(r.id, r["rank"]): (r.neighbour, r.d2) for r in graph.knn(df, 4, block=6, held=1).collect()}
    want = {}
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(len(x)):
            step = x - x[i]
            d = step[:, 0] * step[:, 0] + step[:, 1] * step[:, 1] + step[:, 2] * step[:, 2]
            near = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i and np.isfinite(d[j])][:4]
            want |= {(i, rank + 1): (j, d[j]) for rank, j in enumerate(near)}
    assert got == want


def test_knn_shuffles_no_copies_of_blocks(spark):
    def written():
        time.sleep(1)  # the figures are kept by a listener
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()

    x = np.random.default_rng(4).normal(size=(640, 64))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    before = written()
    assert graph.knn(df, 2, block=20).count() == 1280
    assert written() - before < 4 * x.nbytes


def test_principal_axes_span_the_variance(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) * [5, 1, 0.1]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    _, axes = latents.principal_axes(df, "v", 2)
    assert abs(axes[0, 0]) > 0.99 and abs(axes[1, 1]) > 0.99


def test_reflection_and_sizes(spark):
    rows = spark.createDataFrame([(-1, 4), (0, 4), (4, 4), (7, 4), (5, 1)], "i long, n long")
    assert [r.r for r in rows.select(E.reflected(F.col("i"), F.col("n")).alias("r")).collect()] == [1, 0, 2, 1, 0]


def test_natural_key(spark):
    names = spark.createDataFrame([("a10",), ("a9",), ("b1",), ("a9b",)], "s string")
    assert [r.s for r in names.orderBy(E.natural_key(F.col("s"))).collect()] == ["a9", "a9b", "a10", "b1"]


def test_cumulative_objects(spark):
    seen = spark.createDataFrame([(1, 0, 7), (1, 5, 7), (1, 5, 8), (1, 9, 8), (2, 3, 1)], "sequence long, frame long, object long")
    got = {(r.sequence, r.frame): r.known for r in sequences.cumulative_objects(seen).collect()}
    assert got == {(1, 0): 1, (1, 5): 1, (1, 9): 2, (2, 3): 1}


def test_momentum_mean(spark):
    rows = spark.createDataFrame([("v", i, float(i)) for i in range(20)], "video string, frame long, x double")
    mean = 0.0
    for n in range(20):
        mean += (n - mean) * max(1 / (n + 1), 0.1)
    assert abs(metrics.momentum_mean(rows, "x").first()["mean"] - mean) < 1e-9


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.label for r in graph.components(links).collect()} == {0}


def test_components_by_rounds_of_contraction(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(120)]
    roots = {x: x for p in pairs for x in p}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        roots[max(a, b)] = min(a, b)
    wanted = {x: find(x) for x in roots if find(x) != x}
    links = spark.createDataFrame(pairs, "a long, b long").repartition(8)
    for most in (1 << 20, 16):
        got = {r.node: r.label for r in graph.components(links, most).collect()}
        assert {x: y for x, y in got.items() if x != y} == wanted


def test_compressed_run_lengths(spark):
    def brute(counts):
        out = ""
        for i, c in enumerate(counts):
            x = c - counts[i - 2] if i > 2 else c
            while True:
                low, x = x & 31, x >> 5
                more = x != -1 if low & 16 else x != 0
                out += chr(48 + low + (32 if more else 0))
                if not more:
                    break
        return out

    lists = [[0, 1, 3], [5, 100, 2, 7, 99999, 3, 1, 1], [16, 32, 31, 15, 47, 1 << 20], []]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(lists)], "i int, c array<long>").select("i", E.compressed_counts(F.col("c")).alias("s")).collect()
    assert {r.i: r.s for r in rows} == {i: brute(c) for i, c in enumerate(lists)}


def test_suppression_again_after_cleaning(spark):
    grids = (["111111......", "1.1111......", "111111......"], ["11111.......", "11111.......", "11111......."], ["......1111..", "......1111..", "............"])
    rows = [(0, roi + 1, y, x) for roi, grid in enumerate(grids) for y, line in enumerate(grid) for x, c in enumerate(line) if c == "1"]
    px = spark.createDataFrame(rows, "frame long, roi long, y long, x long")
    scores = spark.createDataFrame([(0, 1, 9.0), (0, 2, 5.0), (0, 3, 1.0)], "frame long, roi long, score double")
    kept = masks.recleaned(masks.runs_of(px), scores, 3, 12, 2).select("roi", "score").distinct().collect()
    # the first mask had a hole, so it gives way to the second, which it overlaps, in spite of its higher score
    assert sorted(tuple(r) for r in kept) == [(2, 1), (3, 1)]


def test_small_regions_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    h, w, least = 14, 17, 5
    grids = {(f, r): rng.random((h, w)) < 0.55 for f in range(3) for r in (1, 2)}

    def parts(grid):
        seen, out = np.zeros_like(grid), []
        for y, x in zip(*np.nonzero(grid), strict=True):
            if not seen[y, x]:
                seen[y, x], todo, part = True, [(y, x)], []
                while todo:
                    a, b = todo.pop()
                    part.append((a, b))
                    for c in range(max(a - 1, 0), min(a + 2, h)):
                        for d in range(max(b - 1, 0), min(b + 2, w)):
                            if grid[c, d] and not seen[c, d]:
                                seen[c, d] = True
                                todo.append((c, d))
                out.append(part)
        return out

    wanted = set()
    for (f, r), grid in grids.items():
        filled = grid.copy()
        for part in parts(~grid):
            if len(part) < least:
                for y, x in part:
                    filled[y, x] = True
        found = parts(filled)
        large = [p for p in found if len(p) >= least] or [max(found, key=len)]
        same = {p for part in large for p in part} == set(zip(*np.nonzero(grid), strict=True))
        wanted |= {(f, r, int(y), int(x), int(same)) for part in large for y, x in part}
    px = spark.createDataFrame([(f, r, int(y), int(x)) for (f, r), g in grids.items() for y, x in zip(*np.nonzero(g), strict=True)], "frame long, roi long, y long, x long")
    done = masks.clean(masks.runs_of(px), h, w, least)
    assert {(p.frame, p.roi, p.y, p.x, p.score) for p in done.select("frame", "roi", "score", "y", F.explode(F.expr("sequence(x0, x1 - 1)")).alias("x")).collect()} == wanted


def test_renaming_refuses_used_names(spark):
    import pytest

    meta = spark.createDataFrame([(0, "walk"), (1, "rest")], "cluster int, name string")
    assert {r.name for r in latents.renamed(meta, 1, "rear").collect()} == {"walk", "rear"}
    for name in ("walk", ""):
        with pytest.raises(ValueError):
            latents.renamed(meta, 1, name)


def test_counts_before_the_first_bad_frame(spark):
    from ethogrid import sources

    rows = spark.createDataFrame([("a", 0, True), ("a", 1, False), ("a", 2, True), ("b", 0, True), ("b", 1, True)], "video string, frame long, ok boolean")
    assert {r.video: r.n for r in sources.frame_counts(rows).collect()} == {"a": 1, "b": 2}
    assert sources.constant_frames(spark, 2, 3, 7).count() == 6


def test_candidates_of_many_images_equal_those_of_each(spark):
    import numpy as np
    import pyarrow as pa
    from ethogrid.operators import generation

    rng, s = np.random.default_rng(3), generation.Settings(side=3, quality=0.2, stability=0.5, offset=4.0)
    images = rng.integers(0, 256, (7, 9, 11, 1), dtype=np.uint8)
    model = generation.Bands()
    found = pa.Table.from_batches(generation._found(model, s, images, pa.RecordBatch.from_pydict({"image": list(range(7))}))).to_pylist()
    wanted = []
    for n, image in enumerate(images):
        for p in range(9):
            for k, (logits, quality) in enumerate(model.candidates(image, (p % 3 + 0.5) / 3 * 11, (p // 3 + 0.5) / 3 * 9)):
                mask, loose = logits > 0, (logits > -4).sum()
                if quality > 0.2 and loose and (logits > 4).sum() / loose >= 0.5:
                    wanted.append((n, p, k, quality, int(mask.sum()), generation.run_lengths(mask)))
    assert len(wanted) > 10 and [(r["image"], r["point"], r["candidate"], r["quality"], r["area"], r["counts"]) for r in found] == wanted


def test_suppression_of_groups_side_by_side(spark):
    import numpy as np
    from ethogrid.operators import boxes

    rng = np.random.default_rng(4)
    sizes = [1, 2, 5, 8, 9, 16, 17, 40, 64, 65, 130, 1, 3]
    starts = np.cumsum([0, *sizes[:-1]])
    x0, y0 = rng.integers(0, 12, (2, sum(sizes)))
    sides = [x0, y0, x0 + rng.integers(1, 9, len(x0)), y0 + rng.integers(1, 9, len(x0))]
    wanted = np.concatenate([boxes._kept(*(c[a : a + n] for c in sides), 3, 10) for a, n in zip(starts, sizes, strict=True)])
    assert (boxes._kept_of_groups(starts, sides, 3, 10) == wanted).all() and 0 < wanted.sum() < len(wanted)


def test_suppression_of_groups_across_arrow_batches(spark):
    from ethogrid.operators import boxes

    rows = [(g, x, 0, x + 4, 4, x) for g in range(40) for x in range(1 + g % 9)]
    frame = spark.createDataFrame(rows, "g long, x0 long, y0 long, x1 long, y1 long, s long")
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "3")
    try:
        got = sorted((r.g, r.x0) for r in boxes.suppress(frame, "g", [F.col("s")]).collect())
    finally:
        spark.conf.set(key, before)
    assert got == [(g, x) for g in range(40) for x in range(0, 1 + g % 9, 3)]


def test_dbscan_of_dense_cells_links_no_pairs_of_points(spark, monkeypatch):
    import random

    from ethogrid.operators import graph

    rng = random.Random(6)
    spots = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(150)] + [(3.0, 3.0)] * 120 + [(3.0, 3.3)] * 4 + [(3.0, 3.6)] + [(float("nan"), 0.0)] * 6
    close = lambda p, q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 0.3 * 0.3
    near = [[j for j, q in enumerate(spots) if j != i and close(p, q)] for i, p in enumerate(spots)]
    core = {i for i, n in enumerate(near) if len(n) + 1 >= 5}
    root, wanted = {}, {}
    for i in sorted(core):
        if i not in root:
            root[i], todo = i, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j in core and j not in root:
                        root[j] = i
                        todo.append(j)
    numbers = {r: k for k, r in enumerate(sorted(set(root.values())))}
    for i in range(len(spots)):
        own = [numbers[root[j]] for j in ([i] if i in core else near[i]) if j in core]
        wanted[i] = min(own, default=-1)
    seen, whole = [], graph.components
    monkeypatch.setattr(graph, "components", lambda links: seen.append(links.count()) or whole(links))
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "id long, x double, y double")
    assert {r.id: r.cluster for r in graph.dbscan(points, ["x", "y"], 0.3, 5).collect()} == wanted
    assert seen[0] < 12 * len(spots)  # 120 copies alone have 7140 pairs
    assert len(set(wanted.values())) > 2


def test_nearest_by_products_equal_exact_sums(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa
    from ethogrid.operators import graph

    rng, sizes, whole = np.random.default_rng(7), [], graph._exact
    x = np.concatenate([rng.normal(size=(300, 16)), 1e6 + rng.normal(size=(100, 16)) * 1e-3])
    x = np.concatenate([x, x[:40], x[350:360]])  # equal ones, and near ones far from the origin
    keys = rng.permutation(len(x)).astype(np.int64)
    d2 = np.zeros((len(x), len(x)))
    for c in range(16):
        d2 += (x[:, c, None] - x[:, c]) ** 2
    wanted = {(int(keys[i]), int(keys[j])) for i in range(len(x)) for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (d2[i, j], keys[j]))[:5]}
    monkeypatch.setattr(graph, "_exact", lambda part, names, y, other, i, j, k: sizes.append(len(i)) or whole(part, names, y, other, i, j, k))
    row = pa.RecordBatch.from_pylist([{"keys": keys.tobytes(), "data": x.tobytes(), "others": keys.tobytes(), "other_data": x.tobytes()}])
    got = pa.Table.from_batches(graph._nearest_of(5)([row])).to_pylist()
    assert {(r["a"], r["b"]) for r in got} == wanted
    at = {int(k): n for n, k in enumerate(keys)}
    assert all(r["d2"] == d2[at[r["a"]], at[r["b"]]] for r in got)
    assert sum(sizes) < len(x) * len(x) / 4  # most pairs aren't summed


def test_cut_leaves_no_stage_behind(spark):
    """An empty side of a join must not end the query while stages of the other side still read its shuffle files."""
    from ethogrid.session import cut

    slow = F.udf(lambda x: __import__("time").sleep(0.5) or x, "long")
    rows = spark.range(0, 16, 1, 4).groupBy("id").agg(F.count("*").alias("n")).withColumn("n", slow("n")).groupBy("n", "id").count()
    empty = spark.range(0, 8, 1, 2).where("id < rand() - 1").groupBy("id").agg(F.count("*").alias("m"))
    keys = "spark.sql.adaptive.optimizer.excludedRules", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = [spark.conf.get(k, None) for k in keys]
    assert cut(empty.join(rows, "id")).count() == 0
    assert not spark.sparkContext.statusTracker().getActiveStageIds()
    assert [spark.conf.get(k, None) for k in keys] == before


def test_drawn_references_are_the_first_good_draws(spark):
    frames = {(s, f): (s * 31 + f * 17) % 50 for s in range(20) for f in range(s)}
    asked = [(s, d, s) for s in range(20) for d in range(7)] + [(None, 1, 5)]

    def expected(s, d, room):
        at = [((s * 7919 + d * 101 + k + 1) % 4294967291 * 265443576 + 11 * 40503 + 12345) % 4294967291 % max(room, 1) for k in range(20)]
        return next((f for f in at if frames.get((s, f), 0) > 40), at[-1])

    rows = spark.createDataFrame([(*k, v) for k, v in frames.items()], "sequence long, frame long, pixels long")
    wanted = {(s, d): expected(s, d, n) if s is not None else None for s, d, n in asked}
    for parts in (None, 3):
        got = sequences.drawn_references(spark.createDataFrame(asked, "sequence long, draw long, room long"), rows, 40, parts=parts).collect()
        assert {(r.sequence, r.draw): r.frame for r in got} == wanted and len(got) == len(wanted)


def test_sample_assembly_has_as_many_rows_a_partition_whatever_the_size(spark, sf_dir, monkeypatch):
    from ethogrid.plans import catalogue, training

    def made():
        found = catalogue.QUERIES["sample_assembly"](spark, sf_dir)
        return sorted(map(tuple, found.collect())), found._jdf.queryExecution().executedPlan().toString()

    few, _ = made()
    monkeypatch.setattr(training, "ROWS", 250)  # of some 6000
    many, plan = made()
    n = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 250)
    assert n > 20 and few == many
    by = re.findall(r"hashpartitioning\((sequence#\d+L(?:, frame#\d+L)?), (\d+)\), REPARTITION_BY_NUM", plan)
    assert {("frame" in keys, int(k)) for keys, k in by} == {(False, n), (True, n)}
