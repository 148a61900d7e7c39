"""Masks as run tables (frame, roi, y, x0, x1) with x1 exclusive: areas, boxes, encodings, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethogrid import functions as E
from ethogrid.operators.boxes import suppress
from ethogrid.operators.graph import trees
from ethogrid.session import cut


def runs_of(pixels: DataFrame) -> DataFrame:
    """Maximal horizontal runs of pixels (frame, roi, y, x)."""
    order = Window.partitionBy("frame", "roi", "y").orderBy("x")
    islands = pixels.select("frame", "roi", "y", "x", (F.col("x") - F.row_number().over(order)).alias("island"))
    spans = islands.groupBy("frame", "roi", "y", "island").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
    return spans.select("frame", "roi", "y", "x0", "x1")


def pixels_of(runs: DataFrame) -> DataFrame:
    return runs.select("frame", "roi", "y", F.explode(F.expr("sequence(x0, x1 - 1)")).alias("x"))


def boxes(runs: DataFrame) -> DataFrame:
    """Inclusive bounding box and area of each mask."""
    return runs.groupBy("frame", "roi").agg(
        F.min("x0").alias("left"), F.min("y").alias("top"), (F.max("x1") - 1).alias("right"), F.max("y").alias("bottom"), F.sum(F.col("x1") - F.col("x0")).alias("area")
    )


def encode(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Column-major run-length counts of each mask; the first counts background and may be 0."""
    position = F.col("x") * height + F.col("y")
    order = Window.partitionBy("frame", "roi").orderBy("position")
    placed = pixels.select("frame", "roi", position.cast("long").alias("position"))
    islands = placed.select("*", (F.col("position") - F.row_number().over(order)).alias("island")).groupBy("frame", "roi", "island").agg(F.min("position").alias("low"), (F.max("position") + 1).alias("high"))
    by = Window.partitionBy("frame", "roi").orderBy("low")
    gaps = islands.select("frame", "roi", "low", (F.col("low") - F.coalesce(F.lag("high").over(by), F.lit(0))).alias("gap"), (F.col("high") - F.col("low")).alias("size"), "high")
    ordered = F.array_sort(F.collect_list(F.struct("low", "gap", "size")))
    packed = gaps.groupBy("frame", "roi").agg(F.flatten(F.transform(ordered, lambda r: F.array(r["gap"], r["size"]))).alias("counts"), F.max("high").alias("end"))
    rest = F.lit(height * width).cast("long") - F.col("end")
    return packed.select("frame", "roi", F.when(rest > 0, F.concat("counts", F.array(rest))).otherwise(F.col("counts")).alias("counts"))


def encoded_area(counts: F.Column) -> F.Column:
    return F.aggregate(F.filter(counts, lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, x: a + x)


def decode(encoded: DataFrame, height: int) -> DataFrame:
    """Pixels of encoded masks."""
    ends = encoded.select("frame", "roi", F.posexplode("counts").alias("k", "n")).withColumn("end", F.sum("n").over(Window.partitionBy("frame", "roi").orderBy("k")))
    spots = ends.where("k % 2 = 1 and n > 0").select("frame", "roi", F.explode(F.expr("sequence(end - n, end - 1)")).alias("position"))
    return spots.select("frame", "roi", (F.col("position") % height).alias("y"), F.expr(f"position div {height}").alias("x"))


def _parted(table: pa.Table) -> pa.Table:
    """The runs of one mask with their component."""
    table = table.sort_by([("y", "ascending"), ("x0", "ascending")])
    y, x0, x1 = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
    left = x0.min(initial=0)
    width = int(x1.max(initial=0) - left) + 2
    begin, end = y * width + x0 - left, y * width + x1 - left
    # runs of the next row that begin at this one's end at the latest and end at its begin at the earliest
    low, high = np.searchsorted(end, begin + width), np.searchsorted(begin, end + width, "right")
    n = np.maximum(high - low, 0)
    one, two = np.repeat(np.arange(len(y)), n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    component = np.arange(len(y))
    child, root = trees(one, two)
    component[child] = root
    return table.append_column("component", pa.array((component + 1).astype(np.int32)))


def components_of(runs: DataFrame) -> DataFrame:
    """runs with `component`: 8-connected parts of each mask, numbered by their first run in raster order.

    Runs touch if they lie in neighbouring rows and their spans, widened by one, overlap. A mask's runs are no more
    than its image has pixels, so each mask is folded by itself, in one Arrow group.
    """
    rows = runs.select("frame", "roi", "y", "x0", "x1")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    return rows.groupBy("frame", "roi").applyInArrow(_parted, schema + ", component int")


def part_sizes(parts: DataFrame) -> DataFrame:
    """Area and unrounded centroid of each component."""
    n = F.col("x1") - F.col("x0")
    middle = (F.col("x0") + F.col("x1") - 1) / 2
    return parts.groupBy("frame", "roi", "component").agg(F.sum(n).alias("area"), (F.sum(middle * n) / F.sum(n)).alias("x"), (F.sum(F.col("y") * n) / F.sum(n)).alias("y"))


def largest(sizes: DataFrame) -> DataFrame:
    """The largest component of each mask; of equal ones the first in raster order."""
    return sizes.groupBy("frame", "roi").agg(F.max_by(F.struct("component", "area", "x", "y"), F.struct("area", -F.col("component"))).alias("top")).select("frame", "roi", "top.*")


def drop_islands(parts: DataFrame, least: int) -> DataFrame:
    """Runs of the components with at least `least` pixels; a mask whose components are all smaller keeps its largest."""
    sizes = part_sizes(parts)
    best = largest(sizes).select("frame", "roi", F.col("component").alias("best"), F.col("area").alias("best_area"))
    kept = sizes.join(best, ["frame", "roi"]).where((F.col("area") >= least) | (F.col("best_area") < least) & (F.col("component") == F.col("best")))
    return parts.join(kept.select("frame", "roi", "component"), ["frame", "roi", "component"], "left_semi").drop("component")


def inverted(runs: DataFrame, height: int, width: int) -> DataFrame:
    """Runs of the background of each mask."""
    masks = runs.select("frame", "roi").distinct()
    rows = masks.select("frame", "roi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))).alias("y"))
    ends = runs.select("frame", "roi", "y", "x0", "x1").unionByName(rows.select("frame", "roi", "y", F.lit(width).cast("long").alias("x0"), F.lit(width).cast("long").alias("x1")))
    before = F.coalesce(F.lag("x1").over(Window.partitionBy("frame", "roi", "y").orderBy("x0")), F.lit(0))
    return ends.select("frame", "roi", "y", before.cast("long").alias("x0"), F.col("x0").alias("x1")).where("x0 < x1")


def fill_holes(runs: DataFrame, height: int, width: int, least: int) -> DataFrame:
    """Runs after background components under `least` pixels are filled."""
    holes = components_of(inverted(runs, height, width))
    small = part_sizes(holes).where(F.col("area") < least).select("frame", "roi", "component")
    filled = holes.join(small, ["frame", "roi", "component"], "left_semi").drop("component")
    return runs_of(pixels_of(runs.select("frame", "roi", "y", "x0", "x1").unionByName(filled)))


def clean(runs: DataFrame, height: int, width: int, least: int) -> DataFrame:
    """Holes filled, islands dropped, and per mask whether it is unchanged (score 1) or not (score 0)."""
    runs = cut(runs)
    done = cut(drop_islands(components_of(fill_holes(runs, height, width, least)), least))
    shape = lambda r, c: r.groupBy("frame", "roi").agg(F.array_sort(F.collect_list(F.struct("y", "x0", "x1"))).alias(c))
    judged = shape(done, "now").join(shape(runs, "was"), ["frame", "roi"], "left").select("frame", "roi", F.coalesce(F.col("now") == F.col("was"), F.lit(False)).cast("int").alias("score"))
    return done.join(judged, ["frame", "roi"])


def shifted(runs: DataFrame, dx: F.Column, dy: F.Column) -> DataFrame:
    return runs.withColumns({"y": F.col("y") + dy, "x0": F.col("x0") + dx, "x1": F.col("x1") + dx})


def cropped(runs: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """Runs inside a window, relative to its corner."""
    inside = runs.where((F.col("y") >= top) & (F.col("y") < top + height) & (F.col("x1") > left) & (F.col("x0") < left + width))
    return inside.withColumns({"y": F.col("y") - top, "x0": F.greatest(F.col("x0") - left, F.lit(0)), "x1": F.least(F.col("x1") - left, F.lit(width))})


def flipped(runs: DataFrame, width: int) -> DataFrame:
    """Runs mirrored left to right."""
    return runs.withColumns({"x0": width - F.col("x1"), "x1": width - F.col("x0")})


def overlaid(under: DataFrame, over: DataFrame) -> DataFrame:
    """Pixels (frame, y, x, roi) of two layers; the upper one's label wins where it is not 0."""
    keys = ["frame", "y", "x"]
    both = under.withColumnRenamed("roi", "below").join(over.withColumnRenamed("roi", "above"), keys, "full")
    return both.select(*keys, F.coalesce(F.nullif("above", F.lit(0)), "below").alias("roi"))


def recleaned(runs: DataFrame, scores: DataFrame, height: int, width: int, least: int) -> DataFrame:
    """The cleaned masks that suppression of their boxes keeps within each frame, unchanged masks before changed ones.

    scores has frame, roi and score, a total order within a frame together with roi.
    """
    done = cut(clean(runs, height, width, least))
    framed = boxes(done).join(done.select("frame", "roi", "score").distinct(), ["frame", "roi"]).join(scores.withColumnRenamed("score", "own"), ["frame", "roi"])
    rows = framed.select("frame", "roi", F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("right") + 1).alias("x1"), (F.col("bottom") + 1).alias("y1"), "score", "own")
    kept = suppress(rows, "frame", [-F.col("score"), -F.col("own"), F.col("roi")], carry=["roi"])
    return done.join(kept.select("frame", "roi"), ["frame", "roi"])


#: Steps (dy, dx) to the neighbours, against the clock from the right.
AROUND = ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1))
#: By which neighbours are there (a bit each) and which one a walk came from: the next one against the clock.
TURN = np.array([[next(((back + k) % 8 for k in range(1, 9) if code >> (back + k) % 8 & 1), 0) for back in range(8)] for code in range(256)])


def _outline(table: pa.Table) -> pa.Table:
    """The chain of one part: its first pixel in raster order, then along the border until the walk would repeat itself."""
    y, x0, x1 = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
    top, left = y.min() - 1, x0.min() - 1
    grid = np.zeros((y.max() - top + 2, x1.max() - left + 1), np.uint8)
    for r, a, b in zip((y - top).tolist(), (x0 - left).tolist(), (x1 - left).tolist(), strict=True):
        grid[r, a:b] = 1
    width = grid.shape[1]
    code = np.zeros(grid.shape, np.int64)
    for k, (dy, dx) in enumerate(AROUND):
        code |= np.roll(grid, (-dy, -dx), (0, 1)).astype(np.int64) << k  # the frame of zeros keeps sides apart
    code, steps = code.ravel().tolist(), [dy * width + dx for dy, dx in AROUND]
    at = begin = int(np.flatnonzero(grid)[0])
    # nothing lies above or to the left of the first pixel: with the clock from the left, its first neighbour closes the chain
    back = close = next((k for k in (3, 2, 1, 0, 7, 6, 5) if code[at] >> k & 1), -1)
    spots, corners = [at], [True]
    turn = TURN.tolist()
    if back >= 0:
        spots, corners = [], []
        while True:
            way = turn[code[at]][back]
            spots.append(at)
            corners.append(way != (back + 4) % 8)
            at, back = at + steps[way], (way + 4) % 8
            if at == begin and back == close:
                break
    place = np.array(spots)
    n = len(place)
    return pa.table({"frame": table.column("frame").take([0] * n), "roi": table.column("roi").take([0] * n), "place": pa.array(np.arange(n)), "y": pa.array(place // width + top), "x": pa.array(place % width + left), "corner": pa.array(corners)})


def largest_part(runs: DataFrame) -> DataFrame:
    """The runs of each mask's largest component, of equal ones the first in raster order."""
    parts = components_of(runs)
    best = largest(part_sizes(parts)).select("frame", "roi", "component")
    return parts.join(best, ["frame", "roi", "component"], "left_semi").drop("component")


def contour(runs: DataFrame) -> DataFrame:
    """frame, roi, place, y, x, corner: the outer border of each mask's largest component, as a closed chain.

    It begins at the component's first pixel in raster order and runs against the clock, with 8 neighbours; a pixel of a thin
    part is passed on both ways. Holes have no part in it. A corner is a pixel at which the chain changes its direction; a
    single pixel is one. A mask is walked by itself, in one Arrow group, as its image bounds it.
    """
    rows = largest_part(runs).select("frame", "roi", "y", "x0", "x1")
    kinds = dict(rows.dtypes)
    return rows.groupBy("frame", "roi").applyInArrow(_outline, f"frame {kinds['frame']}, roi {kinds['roi']}, place long, y long, x long, corner boolean")


def closest(points: DataFrame, x: float, y: float) -> DataFrame:
    """The corner of each contour that is closest to (x, y); of equally close ones the first in the chain. Contours of one
    pixel have none."""
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    found = points.where("corner").groupBy("frame", "roi").agg(F.min(F.struct(d2.alias("d2"), "place", "y", "x")).alias("at"), F.count("*").alias("n"))
    return found.where("n > 1").select("frame", "roi", "at.y", "at.x", "at.d2")


def blocks(pixels: DataFrame, side: int) -> DataFrame:
    """How many pixels of each mask lie in each block of side by side pixels."""
    return pixels.groupBy("frame", "roi", F.floor(F.col("y") / side).alias("by"), F.floor(F.col("x") / side).alias("bx")).agg(F.count("*").alias("n"))


def large_enough(pixels: DataFrame, least: int) -> DataFrame:
    """The masks with more than `least` pixels, and how many they have."""
    return pixels.groupBy("frame", "roi").agg(F.count("*").alias("area")).where(F.col("area") > least)


def scaled(pixels: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Pixels of a resized image, each with the label of the pixel that its upper left corner falls on.

    A pixel goes to all places whose own source it is: rows ceil(y * new / old) up to ceil((y + 1) * new / old) - 1.
    """
    span = lambda c, old, new: F.expr(f"sequence(ceil({c} * {new} / {old}), ceil(({c} + 1) * {new} / {old}) - 1)")
    there = lambda c, old, new: F.expr(f"ceil(({c} + 1) * {new} / {old}) > ceil({c} * {new} / {old})")
    rows = pixels.where(there("y", height, new_height) & there("x", width, new_width))
    rows = rows.select("frame", "roi", F.explode(span("y", height, new_height)).alias("y"), "x")
    return rows.select("frame", "roi", "y", F.explode(span("x", width, new_width)).alias("x"))


def moved_back(runs: DataFrame, left: F.Column, top: F.Column) -> DataFrame:
    """Runs of a crop in the image's own coordinates."""
    return shifted(runs, left, top)


def _summed(height: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        """A mask's summed-area table, a row for each y from 0 to height: labelled pixels above y and to the left of each x."""
        edge = np.zeros((height + 1, width + 2), np.int64)
        y, x0, x1 = (np.clip(table.column(c).to_numpy().astype(np.int64), 0, high) for c, high in (("y", height - 1), ("x0", width), ("x1", width)))
        np.add.at(edge, (y + 1, x0 + 1), 1)
        np.add.at(edge, (y + 1, x1 + 1), -1)
        sums = edge.cumsum(axis=1).cumsum(axis=1)[:, : width + 1].cumsum(axis=0)
        n = height + 1
        return pa.table({"frame": table.column("frame").take([0] * n), "roi": table.column("roi").take([0] * n), "y": pa.array(np.arange(n)), "sums": pa.array(sums.tolist(), pa.list_(pa.int64()))})

    return run


def summed_areas(runs: DataFrame, height: int, width: int) -> DataFrame:
    """frame, roi, y, sums: sums[x] is how many pixels of the mask lie above y and left of x, so any window's count comes from four
    of them. A mask is one Arrow group, as its image bounds it."""
    kinds = dict(runs.dtypes)
    inside = runs.where(F.col("y").between(0, height - 1)).select("frame", "roi", "y", "x0", "x1")
    return inside.groupBy("frame", "roi").applyInArrow(_summed(height, width), f"frame {kinds['frame']}, roi {kinds['roi']}, y long, sums array<long>")


def window_areas(areas: DataFrame, windows: DataFrame) -> DataFrame:
    """windows with roi and area, for every mask of the window's frame. windows has frame, top, left, height, width, inside the image."""
    above, below = (areas.select("frame", F.col("roi").alias(f"{name}_roi"), F.col("y").alias(f"{name}_y"), F.col("sums").alias(name)) for name in ("above", "below"))
    met = windows.join(above.withColumnRenamed("above_y", "top"), ["frame", "top"]).withColumn("below_y", F.col("top") + F.col("height")).withColumnRenamed("above_roi", "below_roi")
    met = met.join(below, ["frame", "below_y", "below_roi"])
    at = lambda sums, x: F.element_at(sums, (x + 1).cast("int"))
    right = F.col("left") + F.col("width")
    count = at("below", right) - at("below", F.col("left")) - at("above", right) + at("above", F.col("left"))
    return met.select(*windows.columns, F.col("below_roi").alias("roi"), count.alias("area"))


def balanced_crops(runs: DataFrame, height: int, width: int, new_height: int, new_width: int, least: int = 100, most: int = 5, tries: int = 5) -> DataFrame:
    """frame, turn, top, left, good, objects: a window of each frame, drawn up to `tries` times until a mask has more than `least` pixels in
    it, else the last one; objects are the masks that do, `most` of them by a hash, in their order: they are labelled anew from 1."""
    new_height, new_width = min(new_height, height), min(new_width, width)
    areas = cut(summed_areas(runs, height, width))
    frames = areas.select("frame").distinct()
    seed = F.col("frame") * 31 + F.col("turn") + 1
    windows = frames.select("frame", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("turn")).select(
        "frame",
        "turn",
        E.seeded(seed, height - new_height + 1, 17).cast("long").alias("top"),
        E.seeded(seed, width - new_width + 1, 23).cast("long").alias("left"),
        F.lit(new_height).cast("long").alias("height"),
        F.lit(new_width).cast("long").alias("width"),
    )
    large = F.collect_list(F.when(F.col("area") > least, F.struct(E.seeded(F.col("frame") * 31 + F.col("roi") + 1, 1 << 30, 5).alias("key"), "roi")))
    tried = window_areas(areas, windows).groupBy("frame", "turn", "top", "left").agg(F.array_sort(F.slice(F.array_sort(large), 1, most)["roi"]).alias("objects"))
    good = F.size("objects") > 0
    best = F.min_by(F.struct("turn", "top", "left", good.alias("good"), "objects"), F.struct(~good, F.when(good, F.col("turn")).otherwise(-F.col("turn"))))
    return tried.groupBy("frame").agg(best.alias("best")).select("frame", "best.*")
