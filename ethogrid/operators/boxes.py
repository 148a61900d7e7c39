"""Proposal boxes: filters, grids, coordinate changes and greedy suppression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_crop_edge(box: list[Column], crop: list[float], image: list[float], slack: float = 20.0) -> Column:
    """Whether a side lies within slack of the crop's same side and not within slack of the image's."""
    near = [(F.abs(b - c) <= slack) & ~(F.abs(b - i) <= slack) for b, c, i in zip(box, crop, image, strict=True)]
    return near[0] | near[1] | near[2] | near[3]


def to_xywh(box: list[Column]) -> list[Column]:
    return [box[0], box[1], box[2] - box[0], box[3] - box[1]]


def area(box: list[Column]) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def grid_points(n: int) -> Column:
    """An array of the centres of an n by n grid of the unit square, row by row."""
    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: F.struct(((i % n + 0.5) / n).alias("x"), ((F.floor(i / n) + 0.5) / n).alias("y")))


def crop_boxes(images: DataFrame, layers: int, overlap: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """layer, x0, y0, x1, y1 of the full image and of each layer's overlapping crops, and columns to carry; images has image, width, height."""
    full = images.select("image", *carry, F.lit(0).alias("layer"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))
    if not layers:
        return full
    per = images.select("*", F.explode(F.sequence(F.lit(1), F.lit(layers))).alias("layer")).where(F.lit(layers) > 0)
    side = F.expr("shiftleft(1, layer)")
    more = F.floor(overlap * F.least("width", "height") * (2.0 / side)).cast("int")
    size = lambda length: F.ceil((more * (side - 1) + length) / side).cast("int")
    sized = per.select("*", side.alias("side"), more.alias("more"), size(F.col("width")).alias("w"), size(F.col("height")).alias("h"))
    steps = sized.select("*", F.explode(F.expr("sequence(0, side - 1)")).alias("i")).select("*", F.explode(F.expr("sequence(0, side - 1)")).alias("j"))
    x, y = F.col("i") * (F.col("w") - F.col("more")), F.col("j") * (F.col("h") - F.col("more"))
    crops = steps.select("image", *carry, "layer", x.alias("x0"), y.alias("y0"), F.least(x + F.col("w"), F.col("width")).alias("x1"), F.least(y + F.col("h"), F.col("height")).alias("y1"))
    return full.unionByName(crops)


def _kept(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Which boxes greedy suppression keeps, in the order given."""
    size, open_ = (x1 - x0) * (y1 - y0), np.ones(len(x0), bool)
    for k in range(len(x0)):
        if open_[k]:
            rest = np.flatnonzero(open_[k + 1 :]) + k + 1
            wide = np.minimum(x1[k], x1[rest]) - np.maximum(x0[k], x0[rest])
            high = np.minimum(y1[k], y1[rest]) - np.maximum(y0[k], y0[rest])
            inter = np.maximum(wide, 0) * np.maximum(high, 0)
            open_[rest[denominator * inter > numerator * (size[k] + size[rest] - inter)]] = False
    return open_


def _kept_of_groups(starts: np.ndarray, sides: list[np.ndarray], numerator: int, denominator: int, small: int = 64) -> np.ndarray:
    """The same for groups that lie one after another from `starts`; small ones are suppressed side by side, step by step."""
    total = len(sides[0])
    sizes = np.diff(np.append(starts, total))
    open_ = np.ones(total, bool)
    for low, high in ((1, 8), (8, 16), (16, 32), (32, small)):  # so that hardly more than half of a block is empty
        of = np.flatnonzero((sizes > low) & (sizes <= high))
        if len(of):
            at = starts[of, None] + np.arange(sizes[of].max())
            there = at < (starts + sizes)[of, None]
            x0, y0, x1, y1 = (c[np.where(there, at, 0)] for c in sides)
            size = (x1 - x0) * (y1 - y0)
            for k in range(at.shape[1] - 1):
                wide = np.minimum(x1[:, k, None], x1[:, k + 1 :]) - np.maximum(x0[:, k, None], x0[:, k + 1 :])
                high_ = np.minimum(y1[:, k, None], y1[:, k + 1 :]) - np.maximum(y0[:, k, None], y0[:, k + 1 :])
                inter = np.maximum(wide, 0) * np.maximum(high_, 0)
                over = denominator * inter > numerator * (size[:, k, None] + size[:, k + 1 :] - inter)
                there[:, k + 1 :] &= ~(over & there[:, k, None])
            inside = at < (starts + sizes)[of, None]
            open_[at[inside]] = there[inside]
    for g in np.flatnonzero(sizes > small):
        part = slice(starts[g], starts[g] + sizes[g])
        open_[part] = _kept(*(c[part] for c in sides), numerator, denominator)
    return open_


def suppress(boxes: DataFrame, group: str, order: list[Column], numerator: int = 3, denominator: int = 10, carry: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """The boxes that greedy suppression keeps: best first, dropped if they overlap a kept one by more than the share.

    boxes has group, x0, y0, x1, y1 (whole numbers); order must be total. A group is an image, whose proposals are
    bounded by the model that makes them. Groups are dealt to tasks, sorted there, and read in Arrow batches: a task holds one batch and the
    group that it ends within, with whole numbers.
    """
    names = [f"o{i}" for i in range(len(order))]
    sides = ["x0", "y0", "x1", "y1"]
    rows = boxes.select(group, *[F.col(c).cast("long").alias(c) for c in sides], *carry, *[c.alias(n) for c, n in zip(order, names, strict=True)])

    def judged(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = _kept_of_groups(starts, [table.column(c).to_numpy() for c in sides], numerator, denominator)
        yield from table.filter(pa.array(keep)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            if held and held[-1].column(0)[-1] == batch.column(0)[0] == batch.column(0)[-1]:
                held.append(batch)  # all of the group that is held already
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            starts = _starts(table.column(0))
            held = table.slice(int(starts[-1])).to_batches()
            if len(starts) > 1:
                yield from judged(table.slice(0, int(starts[-1])), starts[:-1])
        if held:
            yield from judged(pa.Table.from_batches(held).combine_chunks(), np.zeros(1, np.int64))

    out = rows.drop(*names)
    dealt = rows.repartition(group).sortWithinPartitions(group, *names).drop(*names)
    return dealt.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in out.dtypes))


def _starts(column: pa.ChunkedArray) -> np.ndarray:
    """Where each run of equal values begins."""
    codes = column.combine_chunks().dictionary_encode()
    codes = codes.indices.fill_null(-1).to_numpy() if not isinstance(codes, pa.ChunkedArray) else np.concatenate([c.indices.fill_null(-1).to_numpy() for c in codes.chunks])
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
