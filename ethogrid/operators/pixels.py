"""Operators on frame pixels: alignment, colouring, and features by a plug-in model.

They are the ones that relational operators can't express; frames and masks meet by key first, and
one pass over the joined rows does the rest. A model is any object with features(frames, masks, roi);
each worker builds it once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PALETTE = ((0, 0, 0), (230, 80, 60), (60, 140, 230), (90, 190, 90), (240, 200, 60))


@dataclass(frozen=True)
class Preprocess:
    """What is done to a frame, in this order: centre, turn, crop, background. Turning and cropping need centring."""

    roi: int = 1
    centre: bool = True
    degrees: float = 0.0
    crop: tuple[int, int] | None = None
    remove_background: bool = False


def warped(image: np.ndarray, degrees: float, dx: float, dy: float, smooth: bool = True) -> np.ndarray:
    """The image turned about its middle after a shift; what comes from outside is 0. Labels need smooth=False."""
    h, w = image.shape[:2]
    cy, cx = h // 2, w // 2
    angle = np.radians(degrees)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    u = np.cos(angle) * (x - cx) - np.sin(angle) * (y - cy) + cx - dx
    v = np.sin(angle) * (x - cx) + np.cos(angle) * (y - cy) + cy - dy

    def at(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        ok = (rows >= 0) & (rows < h) & (columns >= 0) & (columns < w)
        got = image[np.clip(rows, 0, h - 1), np.clip(columns, 0, w - 1)]
        return np.where(ok.reshape(ok.shape + (1,) * (image.ndim - 2)), got, 0)

    if not smooth:
        return at(np.rint(v).astype(int), np.rint(u).astype(int)).astype(image.dtype)
    v0, u0 = np.floor(v).astype(int), np.floor(u).astype(int)
    fv, fu = (t.reshape(t.shape + (1,) * (image.ndim - 2)) for t in (v - v0, u - u0))
    out = at(v0, u0) * (1 - fv) * (1 - fu) + at(v0, u0 + 1) * (1 - fv) * fu + at(v0 + 1, u0) * fv * (1 - fu) + at(v0 + 1, u0 + 1) * fv * fu
    return np.clip(np.rint(out), 0, 255).astype(image.dtype)


def prepared(frame: np.ndarray, mask: np.ndarray, p: Preprocess) -> tuple[np.ndarray, np.ndarray]:
    """(frame, mask) after preprocessing; ValueError if the ROI isn't in the mask."""
    if p.centre:
        y, x = np.nonzero(mask == p.roi)
        if not len(y):
            raise ValueError("no pixel of the ROI")
        dy, dx = mask.shape[0] // 2 - y.mean(), mask.shape[1] // 2 - x.mean()
        frame, mask = warped(frame, p.degrees, dx, dy), warped(mask, p.degrees, dx, dy, smooth=False)
        if p.crop:
            h, w = mask.shape
            top, left = max(h // 2 - p.crop[1] // 2, 0), max(w // 2 - p.crop[0] // 2, 0)
            cut = (slice(top, h // 2 + p.crop[1] // 2), slice(left, w // 2 + p.crop[0] // 2))
            frame, mask = frame[cut], mask[cut]
    if p.remove_background:
        frame = np.where((mask == 0)[:, :, None], 255, frame).astype(frame.dtype)
    return frame, mask


def overlay(frame: np.ndarray, mask: np.ndarray, share: float = 0.5) -> np.ndarray:
    """Labelled pixels blended with their colour."""
    colors = np.array([PALETTE[i % len(PALETTE)] for i in range(256)], float)[mask]
    return np.where((mask > 0)[:, :, None], frame * (1 - share) + colors * share, frame).astype(np.uint8)


def colourised(mask: np.ndarray) -> np.ndarray:
    return np.array([PALETTE[i % len(PALETTE)] for i in range(256)], np.uint8)[mask]


def _pairs(batch: pd.DataFrame) -> Iterator[tuple]:
    for r in batch.itertuples(index=False):
        yield r.video, r.frame, np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, r.channels), np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width)


def joined(frames: DataFrame, masks: DataFrame) -> DataFrame:
    """Frames with their masks; both have video, frame, height, width."""
    return frames.join(masks.select("video", "frame", "mask"), ["video", "frame"])


def rendered(rows: DataFrame, paint: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """video, frame, height, width, channels, pixels of painted frames, such as overlay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(v, f, *(image := paint(frame, mask)).shape, image.tobytes()) for v, f, frame, mask in _pairs(batch)]
            yield pd.DataFrame(out, columns=["video", "frame", "height", "width", "channels", "pixels"])

    return rows.mapInPandas(run, "video string, frame long, height int, width int, channels int, pixels binary")


def rasterised(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """video, frame, height, width, mask of labelled pixels (video, frame, roi, y, x): dense masks. A frame is one Arrow group,
    which its size bounds; of several labels of a pixel the highest shows."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        mask = np.zeros((height, width), np.uint8)
        at = (table.column("y").to_numpy(), table.column("x").to_numpy())
        np.maximum.at(mask, at, table.column("roi").to_numpy().astype(np.uint8))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        values = (key[0].as_py(), key[1].as_py(), height, width, mask.tobytes())
        return pa.table({c: pa.array([v], k) for c, v, k in zip(("video", "frame", "height", "width", "mask"), values, kinds, strict=True)})

    inside = pixels.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    rows = inside.select(F.col("video").cast("string").alias("video"), F.col("frame").cast("long").alias("frame"), "roi", "y", "x")
    return rows.groupBy("video", "frame").applyInArrow(run, "video string, frame long, height int, width int, mask binary")


def page(p: Preprocess) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """For rendered(): the frame after preprocessing, or a white page of its size where the ROI isn't in the mask."""

    def paint(frame: np.ndarray, mask: np.ndarray) -> np.ndarray:
        try:
            return prepared(frame, mask, p)[0]
        except ValueError:
            h, w = frame.shape[:2]
            if p.centre and p.crop:
                h, w = min(p.crop[1] // 2, h // 2) + min(p.crop[1] // 2, h - h // 2), min(p.crop[0] // 2, w // 2) + min(p.crop[0] // 2, w - w // 2)
            return np.full((h, w, frame.shape[2]), 255, np.uint8)

    return paint


def channel_sums(frames: DataFrame) -> DataFrame:
    """video, frame, height, width, red, green, blue: sums over each frame's pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                sums = np.frombuffer(r.pixels, np.uint8).reshape(-1, r.channels)[:, :3].sum(axis=0, dtype=np.int64)
                out.append((r.video, r.frame, r.height, r.width, *sums.tolist()))
            yield pd.DataFrame(out, columns=["video", "frame", "height", "width", "red", "green", "blue"])

    return frames.mapInPandas(run, "video string, frame long, height int, width int, red long, green long, blue long")


class PatchMeans:
    """A stand-in for a feature model: masked mean colour and the mask's share of the frame."""

    def features(self, frames: list[np.ndarray], masks: list[np.ndarray], roi: int) -> np.ndarray:
        out = []
        for frame, mask in zip(frames, masks, strict=True):
            hit = mask == roi
            if not hit.any():
                raise ValueError("no pixel of the ROI")
            out.append([*frame[hit].mean(axis=0), hit.mean()])
        return np.array(out, np.float32)


#: Models by name; a worker calls the constructor once a task.
MODELS: dict[str, Callable[[], object]] = {"patch_means": PatchMeans}


def latents(rows: DataFrame, model: str, roi: int, p: Preprocess = Preprocess(), batch_size: int = 8, turns: int = 1) -> DataFrame:
    """video, roi, frame, latent of frames joined with masks; with turns > 1 the mean over turned versions.

    If a batch fails, its frames are tried one by one; a frame that fails has a null latent.
    """
    build = MODELS[model]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = build()

        def features(items: list) -> np.ndarray:
            total = 0.0
            for k in range(turns):
                turned = Preprocess(p.roi, p.centre, p.degrees + 360.0 * k / turns, p.crop, p.remove_background)
                ready = [prepared(f, m, turned) for _, _, f, m in items]
                total = total + net.features([f for f, _ in ready], [m for _, m in ready], roi)
            return total / turns

        for batch in batches:
            items, out = list(_pairs(batch)), []
            for low in range(0, len(items), batch_size):
                part = items[low : low + batch_size]
                try:
                    found = list(features(part))
                except Exception:  # a model may raise anything; single frames tell which are bad
                    found = []
                    for item in part:
                        try:
                            found.append(features([item])[0])
                        except Exception:
                            found.append(None)
                out += [(v, roi, f, None if x is None else [float(c) for c in x]) for (v, f, _, _), x in zip(part, found, strict=True)]
            yield pd.DataFrame(out, columns=["video", "roi", "frame", "latent"])

    return rows.mapInPandas(run, "video string, roi int, frame long, latent array<float>")


def tracked(frames: DataFrame, masks: DataFrame, tracker: Callable[[], object], start: int, stop: int) -> DataFrame:
    """video, frame, height, width, mask of an ordered fold over each video's frames start .. stop (backward if start > stop).

    A tracker has refer(frame, mask), called for each labelled frame before the first step, and
    track(frame) -> mask. A video is one group, as each step needs the one before.
    """
    low, high = min(start, stop), max(start, stop)
    # both sides come from frames: columns of their own keep them apart
    rows = frames.where(F.col("frame").between(low, high)).toDF(*frames.columns)

    def run(key: tuple, images: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        fold, out = tracker(), []
        shape = lambda r: (r.height, r.width)
        for r in known.sort_values("frame").itertuples(index=False):
            fold.refer(np.frombuffer(r.pixels, np.uint8).reshape(*shape(r), r.channels), np.frombuffer(r.mask, np.uint8).reshape(shape(r)))
        for r in images.sort_values("frame", ascending=start <= stop).itertuples(index=False):
            mask = fold.track(np.frombuffer(r.pixels, np.uint8).reshape(*shape(r), r.channels))
            out.append((r.video, r.frame, r.height, r.width, mask.astype(np.uint8).tobytes()))
        return pd.DataFrame(out, columns=["video", "frame", "height", "width", "mask"])

    return rows.groupBy("video").cogroup(joined(frames, masks).groupBy("video")).applyInPandas(run, "video string, frame long, height int, width int, mask binary")
