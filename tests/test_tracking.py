"""The stateful fold, outer contours, written stacks and embedding chains against brute force."""

from __future__ import annotations

import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethogrid import sources, streaming
from ethogrid.operators import latents, manifold, masks, sequences
from ethogrid.session import table
from ethogrid.sources import stacks
from ethogrid.streaming import tracking

EVENTS = "video string, place long, kind string, frame long, height int, width int, channels int, pixels binary, mask binary"


def brute_fold(events, memory):
    """place: mask of each tracked frame, by the events in order."""
    long, short, step, noted, objects, out = [], [], 0, 0, 0, {}
    for place, kind, pixels, mask in events:
        if kind == "restart":
            long, short, step, noted, objects = [], [], 0, 0, 0
            continue
        color = np.frombuffer(bytes(pixels), np.uint8).reshape(-1, 3).mean(axis=0)
        refer = kind == "refer"
        if kind != "refer":
            step += 1
            known = long + short[:1]
            found = min(known, key=lambda m: ((m[0] - color) ** 2).sum())[1] if known else bytes(len(mask or b"\0"))
            if kind in ("label", "grow"):
                found = bytes(g or f for g, f in zip(mask, found, strict=True))
            out[place] = mask = found
            refer = kind == "label" or kind == "grow" and max(found) > objects
        if refer:
            objects = max(mask)
        short = [(color, bytes(mask))] if refer else (short + [(color, bytes(mask))])[-memory.skip :]
        if refer or step - noted >= memory.gap:
            long, noted = ([(color, bytes(mask))] + long)[: memory.blocks], step
    return out


def test_events_in_any_order_of_files(spark, sf_dir, tmp_path):
    table(spark, sf_dir, "nation")  # lets workers find the package
    rng, rows, memory = random.Random(2), [], tracking.Memory(gap=3, blocks=4, skip=2)
    for video in ("a", "b"):
        for place in range(40):
            kind = "refer" if place == 0 else rng.choice(["track"] * 6 + ["label", "grow", "restart", "refer"])
            rows.append((video, place, kind, place, 1, 1, 3, bytes(rng.randrange(256) for _ in range(3)), bytes([rng.randrange(4)])))
    mixed = rows[:]
    rng.shuffle(mixed)
    for k in range(4):  # files of events from all over, and each again
        spark.createDataFrame(mixed[20 * k : 20 * k + 25], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    got = streaming.drain(tracking.track(stream, "nearest_colour", memory)).collect()
    for video in ("a", "b"):
        wanted = brute_fold([(p, k, px, m) for v, p, k, _, _, _, _, px, m in rows if v == video], memory)
        assert {r.place: bytes(r.mask) for r in got if r.video == video} == wanted


def test_labels_of_the_start_and_an_unknown_video(spark, sf_dir):
    table(spark, sf_dir, "nation")
    frame = lambda v, f, c: (v, f, 1, 2, 3, bytes([c] * 6))
    schema = "video string, frame long, height int, width int, channels int, pixels binary"
    shots = spark.createDataFrame([frame(v, f, 40 * f) for v in ("a", "b") for f in range(6)], schema)
    labels = spark.createDataFrame([(*frame("a", 0, 0), b"\1\0"), (*frame("a", 5, 200), b"\0\2")], schema + ", mask binary")
    rows = streaming.drain(tracking.track(tracking.streamed(tracking.scheduled(shots, 5, 1), 2), "nearest_colour", tracking.Memory(), labels)).collect()
    assert [(r.frame, bytes(r.mask)) for r in sorted(rows, key=lambda r: r.place) if r.video == "a"] == [(5, b"\0\2"), (4, b"\0\2"), (3, b"\0\2"), (2, b"\0\2"), (1, b"\1\0")]
    assert {bytes(r.mask) for r in rows if r.video == "b"} == {b"\0\0"}


def test_last_reference_across_blocks(spark):
    seen = [("a", f, o) for f, o in ((0, 1), (1, 1), (9, 2), (9, 3), (30, 1), (64, 0))] + [("b", f, 0) for f in range(3)]
    rows = spark.createDataFrame(seen, "sequence string, frame long, object long")
    frames = rows.select("sequence", "frame").distinct()
    got = {(r.sequence, r.frame): (r.reference, r.objects) for r in sequences.as_of(frames, sequences.reference_frames(rows), 8).collect()}
    assert got == {("a", 0): (0, 1), ("a", 1): (0, 1), ("a", 9): (9, 3), ("a", 30): (9, 3), ("a", 64): (9, 3)} | {("b", f): (None, None) for f in range(3)}


def outer_chain(grid):
    """By walking around the outer background: at each pixel the neighbours are tried from the one after where the walk came from."""
    h, w = grid.shape
    steps = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]
    there = lambda y, x: 0 <= y < h and 0 <= x < w and grid[y, x]
    y, x = map(int, next(zip(*np.nonzero(grid), strict=True)))
    near = [s for s in ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)) if there(y + s[0], x + s[1])]
    if not near:
        return [(y, x)], [True]
    before, now, states = (y + near[0][0], x + near[0][1]), (y, x), []
    while (before, now) not in states:
        states.append((before, now))
        at = steps.index((before[0] - now[0], before[1] - now[1]))
        turn = next(s for s in (steps[(at + k) % 8] for k in range(1, 9)) if there(now[0] + s[0], now[1] + s[1]))
        before, now = now, (now[0] + turn[0], now[1] + turn[1])
    assert (before, now) == states[0]
    chain = [s[1] for s in states]
    way = lambda a, b: (b[0] - a[0], b[1] - a[1])
    return chain, [way(chain[k - 1], p) != way(p, chain[(k + 1) % len(chain)]) for k, p in enumerate(chain)]


def parts_of(grid):
    seen, out = np.zeros_like(grid), []
    for y, x in zip(*np.nonzero(grid), strict=True):
        if not seen[y, x]:
            seen[y, x], todo, part = True, [(int(y), int(x))], []
            while todo:
                a, b = todo.pop()
                part.append((a, b))
                for c in range(max(a - 1, 0), min(a + 2, grid.shape[0])):
                    for d in range(max(b - 1, 0), min(b + 2, grid.shape[1])):
                        if grid[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            todo.append((c, d))
            out.append(part)
    return out


def test_outer_contours_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    grids = {(f, r): rng.random((13, 16)) < share for f, share in enumerate((0.15, 0.4, 0.6, 0.85)) for r in (1, 2, 3)}
    grids[9, 1], grids[9, 2] = np.zeros((13, 16), bool), np.zeros((13, 16), bool)
    grids[9, 1][2:9, 3:11] = True
    grids[9, 1][4:6, 5:8] = False  # a hole
    grids[9, 2][7, 7] = True
    px = [(f, r, int(y), int(x)) for (f, r), g in grids.items() for y, x in zip(*np.nonzero(g), strict=True)]
    runs = masks.runs_of(spark.createDataFrame(px, "frame long, roi long, y long, x long"))
    got: dict = {}
    points = masks.contour(runs)
    for p in sorted(points.collect(), key=lambda p: p.place):
        got.setdefault((p.frame, p.roi), []).append(((p.y, p.x), p.corner))
    near = {(p.frame, p.roi): (p.y, p.x) for p in masks.closest(points, 8, 6).collect()}
    for key, grid in grids.items():
        largest = max(parts_of(grid), key=len)  # the first in raster order of equal ones
        alone = np.zeros_like(grid)
        alone[tuple(zip(*largest, strict=True))] = True
        chain, corners = outer_chain(alone)
        assert got[key] == list(zip(chain, corners, strict=True))
        # the chain is the part's pixels that have a side in common with the outside
        padded = np.pad(alone, 1)
        outside, todo = np.zeros_like(padded), [(0, 0)]
        while todo:
            y, x = todo.pop()
            if 0 <= y < padded.shape[0] and 0 <= x < padded.shape[1] and not padded[y, x] and not outside[y, x]:
                outside[y, x] = True
                todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        edge = {(y, x) for y, x in largest if outside[y, x + 1] or outside[y + 2, x + 1] or outside[y + 1, x] or outside[y + 1, x + 2]}
        assert set(chain) == edge
        turns = [p for p, c in zip(chain, corners, strict=True) if c]
        if len(turns) > 1:
            assert near[key] == min(turns, key=lambda p: (p[0] - 6) ** 2 + (p[1] - 8) ** 2)
        else:
            assert key not in near


FRAMES = "video string, frame long, height int, width int, channels int, pixels binary"


def test_stacks_read_back_and_filters_reach_them(spark, tmp_path, sf_dir):
    table(spark, sf_dir, "nation")
    rows = [(v, f, 2, 3, 3, bytes((f + k) % 256 for k in range(18))) for v in ("a", "b.c") for f in range(25)]
    df = spark.createDataFrame(rows, FRAMES).repartition(5)
    sources.write_stacks(df, str(tmp_path / "s"), 10)
    assert sorted(os.path.basename(f) for f in glob.glob(f"{tmp_path}/s/*")) == [f"{v}.{k:012d}.npy" for v in ("a", "b.c") for k in (0, 10, 20)]
    back = sources.read_stacks(spark, str(tmp_path / "s"))
    same = lambda found: sorted((*r[:5], bytes(r[5])) for r in found)
    assert same(back.collect()) == rows
    some = lambda where: sources.read_stacks(spark, str(tmp_path / "s"), where)
    one = some("video = 'b.c' and frame between 8 and 12 and height = 2")
    assert one.rdd.getNumPartitions() == 2 and same(one.collect()) == [r for r in rows if r[0] == "b.c" and 8 <= r[1] <= 12]
    assert back.rdd.getNumPartitions() == 6 and some("video in ('a', 'x') and frame > 19").rdd.getNumPartitions() == 1
    assert some("video = 'x'").count() == 0 and some("frame = 24").count() == 2 and some("frame < 3 and frame >= 1").count() == 4
    assert [back.where("video = 'x'").count(), back.where("frame > 20").count(), back.count()] == [0, 8, 50]
    sources.write_stacks(df.where("video = 'a' and frame < 4"), str(tmp_path / "s"), 10)  # replaces
    assert sources.read_stacks(spark, str(tmp_path / "s")).count() == 4


def test_a_failed_write_leaves_nothing(spark, tmp_path, sf_dir):
    table(spark, sf_dir, "nation")
    rows = [("a", f, 1, 1, 1, b"x") for f in range(6)]
    sources.write_stacks(spark.createDataFrame(rows, FRAMES), str(tmp_path / "s"))
    before = sorted(os.listdir(tmp_path / "s"))
    for bad in ([*rows, ("b", 0, 1, 1, 1, b"x"), ("b", 2, 1, 1, 1, b"x")], [*rows, ("b", 0, 2, 1, 1, b"x")]):  # a gap; too few pixels
        with pytest.raises(Exception, match="leave gaps"):
            sources.write_stacks(spark.createDataFrame(bad, FRAMES), str(tmp_path / "s"))
        assert sorted(os.listdir(tmp_path / "s")) == before
    with pytest.raises(ValueError):
        stacks.StackReader({"path": "s3://x/y"})


def test_files_are_written_all_or_none(spark, tmp_path, sf_dir):
    table(spark, sf_dir, "nation")
    folder = str(tmp_path / "f")
    write = lambda rows: sources.write_blobs(spark.createDataFrame(rows, "name string, content binary").repartition(3), folder)
    write([("a/1", b"x"), ("a/2", b"y"), ("b", b"")])
    write([("a/1", b"z")])
    held = lambda: {os.path.relpath(f, folder): open(f, "rb").read() for f in glob.glob(f"{folder}/**", recursive=True, include_hidden=True) if os.path.isfile(f)}  # noqa: E731, SIM115
    assert held() == {"a/1": b"z", "a/2": b"y", "b": b""}
    for bad in ([("c", b"1"), ("../d", b"2")], [("c", b"1"), ("", b"2")], [("c", b"1"), ("d", None)], [("c", b"1"), ("c", b"2")]):
        with pytest.raises(Exception, match="not a file|one name"):
            write(bad)
        assert held() == {"a/1": b"z", "a/2": b"y", "b": b""}


def test_leading_vectors_equal_a_dense_solver(spark):
    rng = np.random.default_rng(0)
    w = np.zeros((40, 40))
    for i in range(40):
        for j in rng.choice(40, 4, replace=False):
            if i != j:
                w[i, j] = w[j, i] = rng.random()
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(40) for j in range(40) if w[i, j] > 0], "a long, b long, w double")
    got = {r.id: r.e for r in manifold.spectral(edges, 2, tolerance=1e-8).collect()}
    d = w.sum(axis=1)
    axes = np.linalg.eigh(w / np.sqrt(np.outer(d, d)))[1][:, ::-1][:, 1:3]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(2)])
    assert np.abs(np.array([got[i] for i in range(40)]) - axes).max() < 1e-6


def test_two_components_come_apart(spark):
    pairs = [(a, b) for part in (range(5), range(10, 16)) for a in part for b in part if a != b]
    got = {r.id: r.e[0] for r in manifold.spectral(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, w double"), 1).collect()}
    assert {x > 0 for i, x in got.items() if i < 10} != {x > 0 for i, x in got.items() if i >= 10} and len({round(x, 6) for x in got.values()}) == 2
    assert manifold.spectral(spark.createDataFrame([], "a long, b long, w double"), 2).count() == 0


def test_curve_is_a_least_squares_fit():
    assert np.allclose(manifold.curve(0.1), (1.5769434, 0.8950609), atol=1e-5)
    for near in (0.0, 0.3):
        a, b = manifold.curve(near)
        x = np.linspace(0, 3, 300)[1:]
        y = np.where(x < near, 1, np.exp(-(x - near)))
        miss = lambda a, b: ((1 / (1 + a * x ** (2 * b)) - y) ** 2).sum()  # noqa: B023, E731
        assert all(miss(a, b) <= miss(a * s, b * t) for s in (0.99, 1, 1.01) for t in (0.99, 1, 1.01))


def test_a_chain_serves_another_session(spark, tmp_path):
    x = np.random.default_rng(7).normal(size=(120, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    stages = [manifold.Stage(n_components=3, n_epochs=5, start="pca", landmarks=30, place=4, n_neighbors=5), manifold.Stage(n_epochs=5, landmarks=20, place=3, n_neighbors=5)]
    fitted = {r.id: r.e for r in manifold.fit_chain(rows.where("id % 2 = 0"), stages, str(tmp_path / "c")).collect()}
    assert sorted(fitted) == list(range(0, 120, 2)) and {len(e) for e in fitted.values()} == {2}
    other = spark.newSession()
    got = {r.id: r.e for r in manifold.transform_chain(other, other.createDataFrame([(i, x[i].tolist()) for i in range(1, 120, 2)], "id long, v array<double>"), str(tmp_path / "c")).collect()}
    now = {i: x[i] for i in range(1, 120, 2)}
    for k, stage in enumerate(stages):
        marks = spark.read.parquet(f"{tmp_path}/c/{k:03d}/landmarks").collect()
        v, e = np.array([m.v for m in marks]), np.array([m.e for m in marks])
        for i, p in now.items():
            d = np.sqrt(((v - p) ** 2).sum(axis=1))
            near = np.argsort(d)[: stage.place]
            w = 1 / (d[near] + 1e-9)
            now[i] = (w[:, None] * e[near]).sum(axis=0) / w.sum()
    assert got.keys() == now.keys() and all(np.allclose(got[i], now[i]) for i in now)
    with pytest.raises(ValueError):
        manifold.fit_chain(rows, [], str(tmp_path / "d"))


def test_split_goes_on_from_the_metadata(spark):
    current = spark.createDataFrame([(b, c) for b, c in enumerate((0, 0, 0, 1, -1, 0))], "bin long, cluster int")
    local = spark.createDataFrame([(0, 0), (1, 1), (2, -1), (3, 0), (5, 0)], "bin long, cluster int")
    meta = spark.createDataFrame([(0, "C0", "grey"), (1, "C1", "red"), (2, "gone", "blue")], "cluster int, name string, color string")
    bins, named = latents.split(current, local, 0, meta, ["red", "green", "blue", "pink"])
    assert {r.bin: r.cluster for r in bins.collect()} == {0: 3, 1: 4, 2: 0, 3: 1, 4: -1, 5: 3}
    assert sorted(map(tuple, named.where(F.col("cluster") > 2).collect())) == [(3, "C3", "green"), (4, "C4", "pink")]


class Calls:
    """Stands for the states of one key, and counts the calls to them."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def __getattr__(self, name):
        def run(*args):
            self.calls += 1
            if name == "updateValue":
                self.values[args[0]] = args[1]
            elif name == "update":
                self.values["one"] = args[0]
            elif name == "put":
                self.values["list"] = list(args[0])
            elif name in ("removeKey", "getValue"):
                return self.values.pop(args[0]) if name == "removeKey" else self.values[args[0]]
            elif name == "keys":
                return list(self.values)
            elif name == "exists":
                return bool(self.values)
            elif name == "containsKey":
                return args[0] in self.values
            elif name == "get":
                return self.values.get("one") if self is not None and "list" not in self.values else self.values["list"]
            return None

        return run


def test_events_in_disorder_within_a_batch_call_no_state_each():
    import pandas as pd

    rng, memory = random.Random(5), tracking.Memory(gap=3, blocks=4, skip=2)
    rows = [("a", p, "refer" if p == 0 else "track", p, 1, 1, 3, bytes(rng.randrange(256) for _ in range(3)), bytes([rng.randrange(4)])) for p in range(600)]
    wanted = brute_fold([(p, k, px, m) for _, p, k, _, _, _, _, px, m in rows], memory)
    for room in (tracking.Ordered.room, 2_000):  # all wait in the task; some in the state
        mixed = rows[:]
        rng.shuffle(mixed)
        fold, states = tracking.Fold(tracking.NearestColour, memory), [Calls() for _ in range(4)]
        fold.tracker, fold.room, fold.row = fold.build(), room, tracking.namedtuple("Event", fold.event)
        fold.waiting, fold.kept, fold.recent, fold.clock = states
        frames = pd.DataFrame(mixed, columns=["video", *tracking.COLUMNS])
        got = []
        for half in (frames[:300], frames[300:]):  # micro-batches, of Arrow batches of 100 rows
            got += list(fold.handleInputRows(("a",), (half[k : k + 100] for k in range(0, 300, 100)), None))
        assert {p: bytes(m) for p, m in pd.concat(got)[["place", "mask"]].itertuples(index=False)} == wanted
        if room == tracking.Ordered.room:
            first = int((frames[:300]["place"] > min(set(range(600)) - set(frames[:300]["place"]))).sum())
            assert sum(s.calls for s in states) <= 3 * first + 20  # those that wait from one micro-batch to the next, and a few a batch


def test_clips_of_events_fold_like_single_ones(spark, sf_dir):
    table(spark, sf_dir, "nation")
    shots = spark.createDataFrame([(v, f, 1, 1, 3, bytes([f * 37 % 256, f % 5, 7])) for v in ("a", "b") for f in range(50)], "video string, frame long, height int, width int, channels int, pixels binary")
    labels = shots.where("frame in (0, 20)").withColumn("mask", F.unhex(F.format_string("%02x", F.col("frame").cast("int") + 1)))
    memory = tracking.Memory(gap=3, blocks=4, skip=2)
    run = lambda **how: {(r.video, r.frame): bytes(r.mask) for r in streaming.drain(tracking.track(tracking.streamed(tracking.scheduled(shots, 0, 99), **how), "nearest_colour", memory, labels)).collect()}
    assert run(clip=8, span=16) == run(span=10) and len(run(clip=100)) == 100


def test_click_sessions_draw_a_roi_once_and_keep_one_state():
    import pandas as pd

    from ethogrid.streaming import clicks

    kinds = ["next" if p % 9 == 8 else "remove" if p % 4 == 3 else "add" for p in range(60)]
    events = pd.DataFrame([("s", p, k, p * 7 % 48, p * 5 % 32) for p, k in enumerate(kinds)], columns=["session", "place", "kind", "x", "y"])
    told, drawn = {}, {}
    for latest in (False, True):
        fold, kept = clicks.Session(clicks.Boxes, 32, 48, latest), Calls()
        fold.segmenter, fold.row, fold.kept, fold.waiting = fold.build(), tracking.namedtuple("Event", fold.event), kept, Calls()
        count, whole = [], fold.segmenter.segment
        fold.segmenter.segment = lambda *a, count=count, whole=whole: count.append(1) or whole(*a)
        got = [r for half in (events[:31], events[31:]) for r in pd.concat(list(fold.handleInputRows(("s",), iter([half]), None))).itertuples(index=False)]
        told[latest], drawn[latest] = {r.place: (r.roi, r.mask) for r in got}, len(count)
        assert kept.calls + fold.waiting.calls == 4  # one get and one update a micro-batch
    assert told[True] == {p: told[False][p] for p in (30, 59)} and drawn[True] < drawn[False] / 4


def test_runs_of_events_are_chosen_together():
    import pandas as pd

    rng, memory = random.Random(7), tracking.Memory(gap=3, blocks=4, skip=2)
    kinds = ["refer" if p == 0 else rng.choice(["track"] * 12 + ["label", "label", "grow", "restart", "refer"]) for p in range(900)]
    color = lambda: bytes(rng.randrange(8) for _ in range(6))  # noqa: E731  few colours, so that ties are frequent
    rows = [(p, k, p, 1, 2, 3, color(), bytes([rng.randrange(5), rng.randrange(5)])) for p, k in enumerate(kinds)]
    wanted = brute_fold([(p, k, px, m) for p, k, _, _, _, _, px, m in rows], memory)
    alone = type("Alone", (), {"encode": tracking.NearestColour.encode, "match": tracking.NearestColour.match})
    for build in (tracking.NearestColour, alone):
        fold = tracking.Fold(build, memory)
        fold.tracker, fold.row = fold.build(), tracking.namedtuple("Event", fold.event)
        fold.waiting, fold.kept, fold.recent, fold.clock = (Calls() for _ in range(4))
        matched, match = [], fold.tracker.match
        fold.tracker.match = lambda *a, matched=matched, match=match: matched.append(1) or match(*a)
        frames = pd.DataFrame(rows, columns=tracking.COLUMNS)
        got = pd.concat([x for half in (frames[:400], frames[400:]) for x in fold.handleInputRows(("a",), iter([half[:150], half[150:]]), None)])
        assert {p: bytes(m) for p, m in got[["place", "mask"]].itertuples(index=False)} == wanted
        assert len(matched) <= kinds.count("grow") if build is tracking.NearestColour else len(matched) > 600


def test_clips_hold_all_events_over_ends_of_batches(spark, sf_dir):
    table(spark, sf_dir, "nation")
    rows = [(v, p, f"{v}{p}") for v in ("a", "b", None) for p in range(70)]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 7)  # clips end where an Arrow batch does
    try:
        events = spark.createDataFrame(rows, "video string, place long, kind string").repartition(5)
        clips = streaming.drain(tracking.streamed(events, span=32, files=2, clip=10)).collect()
    finally:
        spark.conf.set(batch, before)
    assert sorted(((c.video, p, k) for c in clips for p, k in zip(c.place, c.kind, strict=True)), key=repr) == sorted(rows, key=repr)
    assert all(c.place == list(range(c.place[0], c.place[-1] + 1)) and c.place[0] // 10 == c.place[-1] // 10 for c in clips)


def test_short_runs_take_little_room():
    import tracemalloc

    fold = tracking.Fold(tracking.NearestColour, tracking.Memory())
    fold.tracker, row = fold.build(), tracking.namedtuple("Event", fold.event)
    events = [row(p, "restart" if p % 5 == 4 else "track", p, 1, 1, 3, bytes([p, 1, 2]), None) for p in range(50)]
    tracemalloc.start()
    try:
        assert [None if x is None else x.tolist() for x in fold.ready(events)] == [None if p % 5 == 4 else [p, 1, 2] for p in range(50)]
        assert tracemalloc.get_traced_memory()[1] < 1 << 20
    finally:
        tracemalloc.stop()


def test_clicks_of_a_roi_are_taken_together():
    from ethogrid.streaming import clicks

    kinds = ["next" if p % 9 == 8 else "remove" if p % 4 == 3 else "add" for p in range(60)]
    told = {}
    for latest in (False, True):
        fold, taken = clicks.Session(clicks.Boxes, 32, 48, latest), []
        fold.segmenter, row, fold.kept = fold.build(), tracking.namedtuple("Event", fold.event), Calls()
        fold.load()
        take = fold.take
        fold.take = lambda e, *a, take=take, taken=taken: taken.append(e) or take(e, *a)
        fold.take_all([(row(p, k, p * 7 % 48, p * 5 % 32), None) for p, k in enumerate(kinds)])
        fold._draw()
        told[latest] = fold.roi, fold.now, fold.clicks
        assert len(taken) == (kinds.count("next") if latest else 60)
    assert told[True] == told[False]


def test_pixels_of_masks_of_many_shapes(spark):
    from ethogrid import sources

    rng = random.Random(3)
    masks = [(f"v{k % 3}", k, k % 4, k % 5, bytes(rng.randrange(3) for _ in range((k % 4) * (k % 5)))) for k in range(40)] + [("big", 99, 600, 900, b"\2" * 540_000)]
    found = sources.mask_pixels(spark.createDataFrame(masks, "video string, frame int, height int, width int, mask binary").coalesce(1)).collect()
    wanted = [(v, f, m[i], i // w, i % w) for v, f, h, w, m in masks for i in range(len(m)) if m[i]]
    assert sorted(map(tuple, found)) == sorted(wanted)
