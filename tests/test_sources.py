"""Files in and out, pixel operators and the tracking fold."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethogrid import sources
from ethogrid.operators import pixels


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("project")
    (d / "config.json").write_text(json.dumps({"project_name": "p", "source": ["b.mp4", "a.mp4"], "observer_dim": 4, "latent": {"a_ROI_1_latent.npz": "a.mp4", "a_ROI_10_rotation_latent.npz": "a.mp4"}}))
    (d / "new.json").write_text(json.dumps({"project_name": "n"}))
    (d / "bad.json").write_text("{")
    x = np.arange(12, dtype="float32").reshape(3, 4)
    x[1, 2] = np.nan
    np.savez(d / "a_ROI_1_latent.npz", latent=x)
    for video, n in (("v10", 2), ("v9", 11), ("v9", 2)):
        (d / "label" / video).mkdir(parents=True, exist_ok=True)
        np.savez(d / "label" / video / f"{n}.npz", frame=np.zeros((2, 3, 3), "uint8"), mask=np.array([[0, 1, 0], [2, 0, 0]], "uint8"))
    np.savez(d / "label" / "v9" / "3.npz", frame=np.zeros(1))
    rng = np.random.default_rng(0)
    (d / "stacks").mkdir()
    np.save(d / "stacks" / "s.npy", rng.integers(0, 255, (5, 6, 8, 3), dtype=np.uint8))
    return d


def test_projects(spark, folder):
    configs = sources.projects(spark, f"{folder}/*.json")
    assert {r.project_name for r in configs.collect()} == {"p", "n"}
    assert [r.video for r in sources.project_videos(configs).where("project_name = 'p'").orderBy("place", "video").collect()] == ["All", "a.mp4", "b.mp4"]
    assert sorted((r.ordinal, r.roi, r.kind) for r in sources.latent_catalog(configs).collect()) == [(0, 1, "plain"), (1, 10, "rotation")]


def test_latents(spark, folder):
    rows = sources.read_latents(spark, str(folder)).orderBy("frame").collect()
    assert [(r.video, r.roi, r.kind, r.frame, r.latent is None) for r in rows] == [("a", 1, "plain", 0, False), ("a", 1, "plain", 1, True), ("a", 1, "plain", 2, False)]


def test_labels(spark, folder):
    labels = sources.read_labels(spark, f"{folder}/label")
    assert [(r.video, r.frame) for r in labels.collect()] == [("v9", 2), ("v9", 11), ("v10", 2)]
    found = sources.mask_pixels(labels.where("video = 'v10'")).collect()
    assert sorted((r.roi, r.y, r.x) for r in found) == [(1, 0, 1), (2, 1, 0)]
    left = sources.without(labels, spark.createDataFrame([("11, v9",)], "name string"))
    assert left.count() == 2


def test_upsert_and_register(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("z", 1, None)], "key string, version int, value string")
    assert {(r.key, r.value) for r in sources.newest(rows, ["key"], "version").collect()} == {("k", "new"), ("z", None)}
    known = spark.createDataFrame([("a.mp4", "/x/a.mp4")], "video string, path string")
    offered = spark.createDataFrame([("/y/a.mp4",), ("/y/b.MOV",), ("/y/c.txt",)], "path string")
    assert {r.video for r in sources.register(known, offered).collect()} == {"a.mp4", "b.MOV"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("v.a.mp4", 1, "plain", 0, [1.0])], "video string, roi int, kind string, frame long, latent array<float>")
    sources.write_latents(rows, f"{tmp_path}/latents")
    sources.write_latents(rows.withColumn("roi", F.lit(2)), f"{tmp_path}/latents")
    assert spark.read.parquet(f"{tmp_path}/latents").count() == 2
    sources.write_csv(spark.createDataFrame([(3, "x")], "n int, b string"), f"{tmp_path}/csv", "b")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["b", "n"]
    sources.write_srt(spark.createDataFrame([("v.a.mp4", "1\nx\n")], "video string, text string"), f"{tmp_path}/srt")
    assert (tmp_path / "srt" / "name=v").is_dir()


def test_configuration():
    assert sources.parse_steps('{"a": 1}') == [{"a": 1}]
    for bad in ("[]", "3", "[1]", "{"):
        with pytest.raises(ValueError):
            sources.parse_steps(bad)


def frames_and_masks(spark, folder):
    spark.dataSource.register(sources.FrameStacks)
    frames = spark.read.format("frame_stacks").option("path", f"{folder}/stacks").option("frames", 2).load()
    mask = np.zeros((6, 8), np.uint8)
    mask[1:3, 2:4] = 1
    masks = spark.createDataFrame([("s", f, 6, 8, bytearray(mask.tobytes() if f != 3 else bytes(48))) for f in range(5)], "video string, frame long, height int, width int, mask binary")
    return frames, masks


def test_frames_and_latents(spark, folder):
    frames, masks = frames_and_masks(spark, folder)
    assert frames.count() == 5
    rows = pixels.joined(frames, masks)
    got = {r.frame: r.latent for r in pixels.latents(rows, "patch_means", 1, pixels.Preprocess(crop=(4, 4)), batch_size=2).collect()}
    assert [f for f, x in got.items() if x is None] == [3] and len(got) == 5
    turned = pixels.latents(rows.where("frame = 0"), "patch_means", 1, turns=24).first()
    assert len(turned.latent) == 4
    assert pixels.rendered(rows, pixels.overlay).count() == 5


def test_centring_and_turning():
    mask = np.zeros((9, 9), np.uint8)
    mask[1, 1] = 1
    frame = np.repeat(mask[:, :, None] * 200, 3, axis=2)
    moved, at = pixels.prepared(frame, mask, pixels.Preprocess())
    assert at[4, 4] == 1 and moved[4, 4, 0] == 200 and at.sum() == 1
    line = np.zeros((9, 9), np.uint8)
    line[2, 4] = 1
    assert pixels.warped(line, 90, 0, 0, smooth=False)[4, 2] == 1 or pixels.warped(line, 90, 0, 0, smooth=False)[4, 6] == 1
    white, _ = pixels.prepared(frame, mask, pixels.Preprocess(remove_background=True))
    assert white[0, 0, 0] == 255


@pytest.mark.parametrize(("start", "stop", "order"), [(1, 3, [1, 2, 3]), (3, 1, [3, 2, 1])])
def test_tracking_fold(spark, folder, start, stop, order):
    class Echo:  # here, so that it travels by value
        """A tracker that returns the last reference and counts its steps."""

        def refer(self, frame, mask):
            self.mask, self.step = mask, 0

        def track(self, frame):
            self.step += 1
            return self.mask * self.step

    frames, masks = frames_and_masks(spark, folder)
    got = {r.frame: max(r.mask) for r in pixels.tracked(frames, masks.where("frame = 0"), Echo, start, stop).collect()}
    assert [got[f] for f in order] == [1, 2, 3]


def test_projects_come_and_go(spark, tmp_path):
    sources.create_project(spark, str(tmp_path), "one")
    sources.create_project(spark, str(tmp_path), "two")
    with pytest.raises(FileExistsError):
        sources.create_project(spark, str(tmp_path), "one")
    with pytest.raises(ValueError):
        sources.delete_project(spark, str(tmp_path), "one", "")
    with pytest.raises(ValueError):
        sources.create_project(spark, str(tmp_path), "../x")
    assert sorted(r.project_name for r in sources.projects(spark, f"{tmp_path}/*/config.json").collect()) == ["one", "two"]
    sources.delete_project(spark, str(tmp_path), "one", "one")
    assert sorted(r.project_name for r in sources.projects(spark, f"{tmp_path}/*/config.json").collect()) == ["two"]


def test_folders_splits_and_images(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / "p" / name).mkdir(parents=True)
        (tmp_path / "p" / name / "config.json").write_text("{}")
    assert [r.project for r in sources.project_folders(spark, str(tmp_path / "p")).collect()] == ["a", "b"]
    (tmp_path / "split.txt").write_text("  dog \ncat\n\ndog\n")
    assert [r.sequence for r in sources.split_names(spark, str(tmp_path / "split.txt")).collect()] == ["cat", "dog"]
    images = tmp_path / "images"
    (images / "sub").mkdir(parents=True)
    for name in ("x.PNG", "y.txt", "sub/z.png"):
        (images / name).write_bytes(b"1")
    (images / "empty.png").write_bytes(b"")
    assert [r.path.rpartition("/")[2] for r in sources.image_files(spark, str(images)).collect()] == ["x.PNG"]


def test_palette_images_round_trip():
    mask = np.random.default_rng(0).integers(0, 9, (5, 7)).astype(np.uint8)
    palette = np.arange(30).reshape(10, 3)
    png = sources.palette_png(mask, palette)
    assert png.startswith(b"\x89PNG") and (sources.palette_mask(png) == mask).all()


def test_palette_images_with_any_filter_and_depth():
    import struct
    import zlib

    rng = np.random.default_rng(6)

    def png(rows, w, depth, kinds):
        """Lines of bytes, each written by one of the filters."""
        out, above = b"", np.zeros(rows.shape[1], int)
        for line, kind in zip(rows.astype(int), kinds, strict=True):
            left, corner = np.append([0], line[:-1]), np.append([0], above[:-1])
            nearest = [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left.tolist(), above.tolist(), corner.tolist(), strict=True)]
            guess = [np.zeros_like(line), left, above, (left + above) // 2, np.array(nearest)][kind]
            out += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
            above = line
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        packed = zlib.compress(out)
        parts = [chunk(b"IDAT", packed[:7]), chunk(b"IDAT", packed[7:])]
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, len(rows), depth, 3, 0, 0, 0)) + b"".join(parts) + chunk(b"IEND", b"")

    rows = rng.integers(0, 256, (10, 13))
    assert (sources.palette_mask(png(rows, 13, 8, [k % 5 for k in range(10)])) == rows).all()
    for depth in (1, 2, 4):
        mask = rng.integers(0, 1 << depth, (6, 11))
        across = -(-11 * depth // 8)
        bits = np.zeros((6, across * 8), int)
        for k in range(depth):
            bits[:, k : 11 * depth : depth] = mask >> (depth - 1 - k) & 1
        packed = np.packbits(bits.astype(np.uint8), axis=1)
        assert (sources.palette_mask(png(packed, 11, depth, [4, 3, 2, 1, 0, 4])) == mask).all()
    with pytest.raises(ValueError):
        sources.palette_mask(png(rows, 13, 8, [0] * 10).replace(struct.pack(">BB", 8, 3), struct.pack(">BB", 8, 2), 1))


def test_latents_belong_to_the_video_that_they_are_named_after(spark):
    videos = spark.createDataFrame([("a.mp4",), ("b.mp4",)], "video string")
    files = spark.createDataFrame([("a_ROI_1_latent.npz",), ("a_ROI_12_rotation_latent.npz",), ("c_ROI_1_latent.npz",), ("a_ROI_1.npz",)], "file string")
    got = {tuple(r) for r in sources.latents_of(videos, files).collect()}
    assert got == {("a.mp4", 1, "plain", "a_ROI_1_latent.npz"), ("a.mp4", 12, "rotation", "a_ROI_12_rotation_latent.npz"), ("b.mp4", None, None, None)}
