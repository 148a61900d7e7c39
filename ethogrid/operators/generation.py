"""Masks of whole images: a plug-in model is asked at the points of a grid, in every crop, by a function of Arrow batches.

The function gives a row for each candidate mask within the bounds, with its quality, stability, area, box and run lengths; coordinates and
suppression are relational. A model is any object with candidates(image, x, y), which yields (logits, quality), as many at each point; each task
builds it once. One with candidates_all(images, points) is asked about several images of one size together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid.operators import boxes

CANDIDATE = "point int, candidate int, x double, y double, quality double, stability double, area long, left int, top int, right int, bottom int, counts array<long>"


@dataclass(frozen=True)
class Settings:
    """Points a side, crop layers and their overlap, bounds of quality (above it) and stability (at least), the logit that divides a mask from its
    background and how far it is moved to tell stability, the share of overlap (in hundredths) that suppresses, and slack at crop edges."""

    side: int = 32
    layers: int = 0
    overlap: float = 512 / 1500
    quality: float = 0.88
    stability: float = 0.95
    threshold: float = 0.0
    offset: float = 1.0
    suppress: int = 70
    slack: float = 20.0
    #: Candidates of a point but the first, or all of them.
    skip_first: bool = False


class Bands:
    """A stand-in for a model: the pixels whose first channel is within 8, 24 and 72 of the point's; quality is the share of others."""

    def candidates(self, image: np.ndarray, x: float, y: float) -> Iterator[tuple[np.ndarray, float]]:
        red = image[..., 0].astype(int)
        far = np.abs(red - red[min(int(y), len(red) - 1), min(int(x), red.shape[1] - 1)])
        for width in (8, 24, 72):
            yield (width - far).astype(float), float((far >= width).mean())

    def candidates_all(self, images: np.ndarray, points: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
        red = images[..., 0].astype(np.int16)
        h, w = red.shape[1:]
        own = np.stack([red[:, min(int(y), h - 1), min(int(x), w - 1)] for x, y in points], axis=1)
        far = np.abs(red[:, None] - own[..., None, None])[:, :, None]
        width = np.array([8, 24, 72], np.int16)[:, None, None]
        return width - far, (far >= width).mean(axis=(-2, -1))


#: Models by name.
MODELS: dict[str, Callable[[], object]] = {"bands": Bands}


def run_lengths(mask: np.ndarray) -> list[int]:
    """Lengths of the runs down each column in turn; the first is of background and may be 0."""
    flat = mask.T.ravel()
    edges = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    lengths = np.diff(np.concatenate([[0], edges, [flat.size]])).tolist()
    return [0, *lengths] if flat.size and flat[0] else lengths


def asked(model, images: np.ndarray, points: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Logits (image, point, candidate, height, width) and quality (image, point, candidate) of images of one size."""
    if hasattr(model, "candidates_all"):
        return model.candidates_all(images, points)
    found = [[list(model.candidates(image, x, y)) for x, y in points] for image in images]
    return np.array([[[c[0] for c in p] for p in image] for image in found]), np.array([[[c[1] for c in p] for p in image] for image in found], float)


def _runs(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """run_lengths of several masks of one size: the lengths one after another, and where each mask's begin and end."""
    n, (h, w) = len(masks), masks.shape[1:]
    flat = np.zeros((n, h * w + 1), bool)
    flat[:, 1:] = masks.transpose(0, 2, 1).reshape(n, h * w)
    turn = np.ones((n, h * w + 1), bool)  # where a run begins; before the first pixel there is background
    turn[:, :-1] = flat[:, 1:] != flat[:, :-1]
    row, at = np.nonzero(turn)
    first = np.concatenate([[True], row[1:] != row[:-1]])
    lengths = np.where(first, at, at - np.concatenate([[0], at[:-1]]))
    return lengths, np.concatenate([[0], np.cumsum(turn.sum(axis=1))])


def _finder(model: str, s: Settings, kept: list[str], room: int = 8 << 20):
    """A task's crops to candidates that pass the bounds, with `kept` columns beside them; crops of one size are asked together, up to about `room` logits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plug = MODELS[model]()
        for batch in batches:
            shapes = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("full_height", "full_width", "channels", "x0", "y0", "x1", "y1")], axis=1)
            kinds, of = np.unique(shapes, axis=0, return_inverse=True)
            for k, (height, width, channels, x0, y0, x1, y1) in enumerate(kinds.tolist()):
                h, w, rows = y1 - y0, x1 - x0, np.flatnonzero(of.ravel() == k)
                step = max(1, room // max(1, h * w * s.side * s.side * 4))
                for low in range(0, len(rows), step):
                    part = rows[low : low + step]
                    pixels = batch.column("pixels").take(pa.array(part)).to_pylist()
                    images = np.frombuffer(b"".join(pixels), np.uint8).reshape(len(part), height, width, channels)[:, y0:y1, x0:x1]
                    yield from _found(plug, s, images, batch.select(kept).take(pa.array(part)))

    return run


def _found(plug, s: Settings, images: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    h, w = images.shape[1:3]
    points = [((p % s.side + 0.5) / s.side * w, (p // s.side + 0.5) / s.side * h) for p in range(s.side * s.side)]
    logits, quality = asked(plug, images, points)
    over = lambda bound: (logits > bound).sum(axis=(-2, -1))
    loose, tight = over(s.threshold - s.offset), over(s.threshold + s.offset)
    with np.errstate(invalid="ignore", divide="ignore"):
        stability = tight / loose
    good = (loose > 0) & (np.isnan(quality) | (quality > s.quality)) & (stability >= s.stability)
    if s.skip_first:
        good[..., 0] = False
    i, p, k = np.nonzero(good)
    masks = logits[i, p, k] > s.threshold
    across, down = masks.any(axis=1), masks.any(axis=2)
    some = across.any(axis=1)
    first, last = lambda m: np.where(some, m.argmax(axis=1), 0), lambda m: np.where(some, m.shape[1] - 1 - m[:, ::-1].argmax(axis=1), 0)
    place = np.array(points).reshape(-1, 2)[p]
    lengths, ends = _runs(masks)
    counts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lengths, pa.int64()))
    columns = [(p, "i4"), (k, "i4"), (place[:, 0], "f8"), (place[:, 1], "f8"), (quality[i, p, k], "f8"), (stability[i, p, k], "f8"), (masks.sum(axis=(1, 2)), "i8"), (first(across), "i4"), (first(down), "i4"), (last(across), "i4"), (last(down), "i4")]
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    given = rows.take(pa.array(i))
    yield pa.RecordBatch.from_arrays([*given.columns, *[pa.array(c.astype(t)) for c, t in columns], counts], [*given.schema.names, *names])


def generated(images: DataFrame, model: str, s: Settings = Settings()) -> DataFrame:
    """image, layer, crop, point, candidate, x, y, quality, stability, area, left, top, right, bottom, counts, x0, y0 of the masks that are kept.

    images has image, height, width, channels, pixels. Boxes are inclusive; they and points are in the image's coordinates, counts in those of the crop
    at (x0, y0). Of overlapping boxes within a crop that of higher quality stays, and between crops that of the smaller crop; ties go
    to the smaller crop number, point and candidate.
    """
    crops = boxes.crop_boxes(images, s.layers, s.overlap, ("width", "height", "channels", "pixels"))
    crops = crops.withColumnsRenamed({"width": "full_width", "height": "full_height"}).withColumn("crop", F.concat_ws("/", "layer", "y0", "x0"))
    kept = ["image", "layer", "crop", "x0", "y0", "x1", "y1", "full_width", "full_height"]
    schema = ", ".join([*(f"`{c}` {dict(crops.dtypes)[c]}" for c in kept), CANDIDATE])
    found = crops.mapInArrow(_finder(model, s, kept), schema)
    sides = [("left", "x0"), ("top", "y0"), ("right", "x0"), ("bottom", "y0")]
    placed = found.withColumns({c: F.col(c) + F.col(o) for c, o in sides} | {"x": F.col("x") + F.col("x0"), "y": F.col("y") + F.col("y0")})
    box = [F.col(c) for c, _ in sides]
    near = [(F.abs(b - F.col(c)) <= s.slack) & ~(F.abs(b - i) <= s.slack) for b, c, i in zip(box, ("x0", "y0", "x1", "y1"), (F.lit(0), F.lit(0), F.col("full_width"), F.col("full_height")), strict=True)]
    inside = placed.where(~(near[0] | near[1] | near[2] | near[3]))
    keep = ["image", "layer", "crop", "point", "candidate", "x", "y", "quality", "stability", "area", "left", "top", "right", "bottom", "counts", "x0", "y0"]
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    rows = inside.select(*keep, size.alias("size"), F.concat_ws("|", F.col("image").cast("string"), "crop").alias("part"))
    best = rows
    if s.suppress < 100:  # no box overlaps another by more than the whole
        best = _suppressed(rows, "part", [-F.col("quality"), F.col("point"), F.col("candidate")], s)
    if s.layers and s.suppress < 100:
        best = _suppressed(best, "image", [F.col("size"), F.col("crop"), F.col("point"), F.col("candidate")], s)
    return best.select(*keep)


def _suppressed(rows: DataFrame, group: str, order: list, s: Settings) -> DataFrame:
    """The rows whose boxes greedy suppression keeps, in a group."""
    ends = {"x0": F.col("left"), "y0": F.col("top"), "x1": F.col("right"), "y1": F.col("bottom")}
    flat = rows.withColumnsRenamed({"x0": "crop_x", "y0": "crop_y"}).withColumns(ends)
    kept = boxes.suppress(flat, group, order, s.suppress, 100, carry=[c for c in flat.columns if c not in (group, *ends)])
    return kept.drop(*ends).withColumnsRenamed({"crop_x": "x0", "crop_y": "y0"})
