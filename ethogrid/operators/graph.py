"""Connected components and neighbour joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby, pairwise, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethogrid.session import cut


def trees(a: np.ndarray, b: np.ndarray, by_hash: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(children, roots): each end of the links a, b that isn't the smallest of its tree, by number or by hash, beside that."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    if by_hash:
        x = names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        by = np.argsort((x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9), kind="stable")
        place = np.empty(len(names), np.int64)
        place[by] = np.arange(len(names))
        names, ends = names[by], place[ends]
    a, b, root = ends[: len(a)], ends[len(a) :], np.arange(len(names))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    child = np.flatnonzero(root != np.arange(len(names)))
    return names[child], names[root[child]]


def _forest(by_hash: bool):
    """A spanning forest of a partition's links."""

    def run(batches):
        parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if len(b)]
        if parts:
            child, root = trees(*(np.concatenate(x) for x in zip(*parts, strict=True)), by_hash)
            yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(root)], ["a", "b"])

    return run


def replaced(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """The rows with what labels (node, label) say in the place of the column's values."""
    named = labels.select(F.col("node").alias(column), F.col("label").alias("_new"))
    return rows.join(named, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*rows.columns)


def components(links: DataFrame, most: int = 1 << 20) -> DataFrame:
    """node and label, the smallest node that links (a, b; whole numbers) reach, for every node that isn't that itself.

    Links are contracted to forests inside partitions, of which there are as few as hold `most` links each; one
    partition's forest is the answer. While there are several, every node points to the neighbour with the smallest
    hash, and on to that one's own choice; nodes are then replaced by what they point to, equal links become one and
    those inside a node vanish. So links get fewer by a factor a round, whatever the shape of the components.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("id"))
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = cut(links.where("a <> b").mapInArrow(_forest(True), "a long, b long"))
    found = None
    while (tasks := -(-edges.count() // most)) > 1:
        edges = cut(edges.coalesce(tasks).mapInArrow(_forest(True), "a long, b long").distinct())
        both = edges.union(edges.select("b", "a"))
        points = both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("low"))
        points = points.select("node", F.least("low", order("node"))["id"].alias("to"))
        beyond = points.select(F.col("node").alias("to"), F.col("to").alias("label"))
        points = cut(points.join(beyond, "to").select("node", "label"))
        edges = cut(replaced(replaced(edges, "a", points), "b", points).where("a <> b").distinct())
        found = points if found is None else replaced(found, "label", points)
    roots = cut(edges.coalesce(1).mapInArrow(_forest(False), "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("label")))
    if found is None:
        return roots
    # nodes that vanished on the way have the label of what they were replaced by
    found = replaced(found, "label", roots)
    first = found.groupBy("label").agg(F.min("node").alias("first"))
    named = found.join(first, "label").select("node", F.least("first", "label").alias("label"))
    return cut(named.unionByName(first.select(F.col("label").alias("node"), F.least("first", "label").alias("label"))).distinct())


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda s, t: s + t, [(x - y) * (x - y) for x, y in zip(a, b, strict=True)])


def within(points: DataFrame, axes: list[str], radius: float, key: str = "id") -> DataFrame:
    """Pairs a < b of points at most `radius` apart, with their squared distance d2.

    Points are dealt to grid cells as wide as the radius in the first two axes; a point meets only the
    points of its own and the neighbouring cells.
    """
    grid = axes[:2]
    cell = [F.floor(F.col(c) / radius).cast("long").alias(f"cell{i}") for i, c in enumerate(grid)]
    own = points.select(key, *axes, *cell)
    steps = F.array(*[F.struct(*[F.lit(s).alias(f"s{i}") for i, s in enumerate(step)]) for step in product((-1, 0, 1), repeat=len(grid))])
    spread = own.select(key, *axes, *[f"cell{i}" for i in range(len(grid))], F.explode(steps).alias("step"))
    spread = spread.select(F.col(key).alias("b"), *[F.col(c).alias(f"b_{c}") for c in axes], *[(F.col(f"cell{i}") + F.col(f"step.s{i}")).alias(f"cell{i}") for i in range(len(grid))])
    pairs = own.withColumnRenamed(key, "a").join(spread, [f"cell{i}" for i in range(len(grid))]).where("a < b")
    d2 = squared_distance([F.col(c) for c in axes], [F.col(f"b_{c}") for c in axes])
    return pairs.select("a", "b", d2.alias("d2")).where(F.col("d2") <= radius * radius)


def _touch(eps: float, chunk: int = 1 << 16):
    """Which pairs of cells hold points within eps of each other; nearest to the other cell first, so most are settled by a few."""

    def close(own: np.ndarray, other: np.ndarray) -> bool:
        gap = lambda p, q: (np.maximum(np.maximum(q.min(axis=0) - p, p - q.max(axis=0)), 0) ** 2).sum(axis=1)
        bound = eps * eps * (1 + 1e-9)
        near, far = gap(own, other), gap(other, own)
        own, other = own[near <= bound][np.argsort(near[near <= bound])], other[far <= bound][np.argsort(far[far <= bound])]
        step = max(1, chunk // max(1, len(other)))
        for low in range(0, len(own), step):
            d = [(own[low : low + step, None, k] - other[:, k]) for k in range(own.shape[1])]
            if (sum(x * x for x in d) <= eps * eps).any():
                return True
        return False

    def run(batches):
        for batch in batches:
            points = [[np.array([list(p.values()) for p in row], float) for row in batch.column(c).to_pylist()] for c in ("points", "others")]
            keep = [close(own, other) for own, other in zip(*points, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def dbscan(points: DataFrame, axes: list[str], eps: float, least: int = 5, key: str = "id") -> DataFrame:
    """key and cluster: density clusters numbered by their smallest core point; a border point joins the lowest
    neighbouring cluster and -1 is noise. A point counts itself.

    For few axes, as a cell has 5 to the power of their number (3 at most) neighbours. Points are dealt to cells so small that all points of one are neighbours: of a cell with `least` points all are core, and only
    the few points of other cells are counted one by one. Core points of a cell are one node of the links, and two cells are
    linked by any pair of theirs; so work and memory follow the number of points, not that of their pairs.
    """
    side, cells = eps / len(axes) ** 0.5 * (1 - 1e-6), [f"cell{i}" for i in range(len(axes))]
    finite = reduce(lambda s, t: s & t, [F.abs(F.col(c)) < float("inf") for c in axes])
    own = points.where(finite).select(F.col(key).alias("a"), *[F.col(c).cast("double").alias(f"p{i}") for i, c in enumerate(axes)])
    place = [f"p{i}" for i in range(len(axes))]
    own = own.select("*", *[F.floor(F.col(p) / side).cast("long").alias(c) for p, c in zip(place, cells, strict=True)])
    sizes = own.groupBy(*cells).agg(F.count("*").alias("n"))
    own = cut(own.join(sizes, cells))
    reach = int(eps / side) + 1
    steps = list(product(range(-reach, reach + 1), repeat=len(axes)))

    def moved(rows: DataFrame, columns: list[str], by: list) -> DataFrame:
        """The rows beside each cell at one of the steps."""
        step = F.explode(F.array(*[F.struct(*[F.lit(s).alias(c) for s, c in zip(x, cells, strict=True)]) for x in by]))
        return rows.select(*columns, *cells, step.alias("step")).select(*columns, *[(F.col(c) + F.col(f"step.{c}")).alias(c) for c in cells])

    def met(few: DataFrame, many: DataFrame, carry: list[str]) -> DataFrame:
        """b and what it carries of many, within eps of a of few; few has fewer than `least` points a cell."""
        spread = moved(few, ["a", *place], steps)
        other = many.select(F.col("a").alias("b"), *[F.col(p).alias(f"b_{p}") for p in place], *cells, *carry)
        d2 = squared_distance([F.col(p) for p in place], [F.col(f"b_{p}") for p in place])
        return spread.join(other, cells).where((F.col("a") != F.col("b")) & (d2 <= eps * eps)).select("a", "b", *carry)

    few = own.where(F.col("n") < least)
    counted = met(few, own, []).groupBy("a").agg(F.count("*").alias("near")).where(F.col("near") + 1 >= least).select("a")
    columns = ["a", *place, *cells]
    core = cut(own.where(F.col("n") >= least).select(*columns).unionByName(few.join(counted, "a", "left_semi").select(*columns)))
    packed = cut(core.groupBy(*cells).agg(F.min("a").alias("node"), F.collect_set(F.struct(*place)).alias("points")))
    half = [x for x in steps if x > (0,) * len(axes)]
    ahead = moved(packed.select(F.col("node").alias("a"), "points", *cells), ["a", "points"], half)
    pairs = ahead.join(packed.select(F.col("node").alias("b"), F.col("points").alias("others"), *cells), cells)
    links = pairs.select("a", "b", "points", "others").mapInArrow(_touch(eps), f"a {dict(core.dtypes)['a']}, b {dict(core.dtypes)['a']}")
    nodes = packed.select(*cells, "node")
    roots = cut(replaced(nodes.withColumn("root", F.col("node")), "root", components(links)).select(*cells, "root"))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("root")) - 1
    clusters = cut(roots.join(roots.select("root").distinct().withColumn("cluster", number), "root").select(*cells, "cluster"))
    inside = cut(core.join(clusters, cells).select("a", *place, *cells, "cluster"))
    edge = few.join(core.select("a"), "a", "left_anti")
    border = met(edge, inside, ["cluster"]).groupBy("a").agg(F.min("cluster").alias("cluster"))
    named = inside.select("a", "cluster").unionByName(border)
    found = points.select(F.col(key).alias("a")).join(named, "a", "left")
    return found.select(F.col("a").alias(key), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


PACKED, FOUND = "block long, keys binary, data binary, narrow boolean", "block long, a binary, b binary, d2 binary"


def _packed(key: str, vector: str):
    """A block of points in one row: keys and vectors, in the order of the keys; in single precision where that loses nothing."""

    def run(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        keys, rows = table.column(key).to_numpy().astype(np.int64), table.column(vector).combine_chunks()
        data = rows.values.to_numpy(zero_copy_only=False).astype(float)
        with np.errstate(over="ignore"):
            brief = data.astype(np.float32)
        narrow = np.array_equal(brief, data, equal_nan=True)
        columns = [pa.array([group[0].as_py()], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (keys, brief if narrow else data)), pa.array([narrow])]
        return pa.table(columns, ["block", "keys", "data", "narrow"])

    return run


class _Nearest:
    """The k nearest of each point of a block, among the blocks that it has met; sums run in the order of the elements.

    A matrix product gives distances that may be wrong in their last digits; those that could be among the k nearest, with a
    margin for its error, are then summed exactly. What is not nearer than the k-th met so far, or known from elsewhere, is left out.
    """

    def __init__(self, names: np.ndarray, x: np.ndarray, k: int, known: tuple[np.ndarray, ...] | None):
        self.names, self.x, self.k = names, np.asfortranarray(x), k
        with np.errstate(over="ignore"):
            self.length = (x * x).sum(axis=1)
        self.wide, self.brief = {}, True
        self.d2, self.b = np.full((len(names), k), np.inf), np.full((len(names), k), np.iinfo(np.int64).max)
        self.edge, self.last = self.d2[:, -1].copy(), self.b[:, -1].copy()
        if known:
            a, b, d2 = known
            low, high = np.searchsorted(a, names), np.searchsorted(a, names, "right")
            full = high - low >= k
            self.edge[full], self.last[full] = d2[low[full] + k - 1], b[low[full] + k - 1]

    def meet(self, other: np.ndarray, y: np.ndarray, chunk: int = 512) -> None:
        if not len(other) or not len(self.names):
            return
        with np.errstate(over="ignore", invalid="ignore"):
            squares = (y * y).sum(axis=1)
            top, longest, rooms = squares.max(), self.length.max(), {}
            y, marks = np.asfortranarray(y), np.empty((chunk, len(other)), bool)
            for low in range(0, len(self.names), chunk):
                part = slice(low, low + chunk)
                # single precision first, unless its margin lets too many pass
                for kind in (np.float32, np.float64) if self.brief and 1e-24 < top < 1e24 and longest < 1e24 else (np.float64,):
                    # a sum of n products is off by at most n roundings of the sum of their sizes
                    slack = 2 * (y.shape[1] + 5) * np.finfo(kind).eps
                    if kind not in rooms:
                        rooms[kind] = np.concatenate([y.T, squares[None] * (slack - 1) / 2]).astype(kind), np.empty((chunk, len(other)), kind)
                    if kind not in self.wide:
                        self.wide[kind] = np.concatenate([self.x, np.ones((len(self.names), 1))], axis=1).astype(kind)
                    own, (columns, room) = self.wide[kind][part], rooms[kind]
                    near = np.matmul(own, columns, out=room[: len(own)])  # half of how much shorter than the point's own squares d2 is
                    self._bound(other, y, near, low)
                    floor = (self.length[part] * (1 - slack) - self.edge[part]) / 2
                    if not np.isfinite(top + longest):
                        floor[:] = -np.inf
                    floor = np.nextafter(floor.astype(kind), -np.inf, dtype=kind)
                    far = np.less(near, floor[:, None], out=marks[: len(own)])
                    hits = np.flatnonzero(np.logical_not(far, out=far))
                    if len(hits) <= near.size // 16:
                        break
                    self.brief = False
                i, j = hits // len(other) + low, hits % len(other)
                if (self.edge[part] == 0).any():  # nothing is nearer than a copy, and of copies the smaller key counts
                    counts = (self.edge[i] > 0) | (other[j] < self.last[i])
                    i, j = i[counts], j[counts]
                for first, end in _pieces(i):
                    self._take(*_exact(self.x, self.names, y, other, i[first:end], j[first:end], self.k))

    def _bound(self, other: np.ndarray, y: np.ndarray, near: np.ndarray, low: int) -> None:
        """The k-th of the roughly nearest k + 1, one of which may be the point itself, bounds points that nothing bounds yet."""
        new = np.flatnonzero(np.isinf(self.edge[low : low + len(near)]))
        if len(new):
            width = min(self.k + 1, len(other))
            j = np.argpartition(near[new], len(other) - width, axis=1)[:, len(other) - width :]
            i, _, d2 = _exact(self.x, self.names, y, other, np.repeat(new + low, width), j.ravel(), self.k)
            full = np.arange(len(i)) - np.searchsorted(i, i) == self.k - 1
            self.edge[i[full]] = d2[full]

    def _take(self, i: np.ndarray, b: np.ndarray, d2: np.ndarray) -> None:
        """What comes nearer than those known."""
        keep = (d2 < self.edge[i]) | ((d2 == self.edge[i]) & (b < self.last[i]))
        rows = np.unique(i[keep])
        i = np.concatenate([np.repeat(rows, self.k), i[keep]])
        i, b, d2 = _first(i, np.concatenate([self.b[rows].ravel(), b[keep]]), np.concatenate([self.d2[rows].ravel(), d2[keep]]), self.k)
        self.b[rows], self.d2[rows] = b.reshape(-1, self.k), d2.reshape(-1, self.k)
        full = rows[np.isfinite(self.d2[rows, -1])]
        self.edge[full], self.last[full] = self.d2[full, -1], self.b[full, -1]

    def found(self) -> tuple[np.ndarray, ...]:
        i, rank = np.nonzero(np.isfinite(self.d2))
        return self.names[i], self.b[i, rank], self.d2[i, rank]


def _exact(part: np.ndarray, names: np.ndarray, y: np.ndarray, other: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """i, the other's name and d2 of the k nearest of the pairs i, j of a point, by exact sums."""
    d2 = np.zeros(len(i))
    for c in range(y.shape[1]):
        step = part[:, c][i] - y[:, c][j]
        d2 += step * step
    fine = np.isfinite(d2) & (names[i] != other[j])
    return _first(i[fine], other[j[fine]], d2[fine], k)


def _first(a: np.ndarray, b: np.ndarray, d2: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k smallest d2 of each a, in their order; ties go to the smaller b."""
    by = np.lexsort((b, d2, a))
    a, b, d2 = a[by], b[by], d2[by]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], d2[keep]


def _pieces(i: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Where pieces of about `most` of the ascending numbers begin and end; equal ones stay together."""
    low = 0
    while low < len(i):
        high = len(i) if low + most >= len(i) else int(np.searchsorted(i, i[low + most], "right"))
        yield low, high
        low = high


def _row(block: int, found: tuple[np.ndarray, ...]) -> list[pa.Array]:
    return [pa.array([block], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in found)]


def _nearest_of(k: int):
    """The k nearest of each point of one block, within the blocks that it is paired with."""

    def of(batch: pa.RecordBatch, at: int, column: str, kind: type) -> np.ndarray | None:
        value = batch.column(column)[at] if column in batch.schema.names else None
        return np.frombuffer(value.as_buffer(), kind) if value is not None and value.is_valid else None

    def points(batch: pa.RecordBatch, at: int, keys: str, data: str, narrow: str) -> tuple[np.ndarray, np.ndarray]:
        """Those whose elements are finite; others are near to none."""
        names, brief = of(batch, at, keys, np.int64), narrow in batch.schema.names and batch.column(narrow)[at].as_py()
        rows = of(batch, at, data, np.float32 if brief else np.float64).reshape(len(names), -1).astype(float)
        finite = np.isfinite(rows).all(axis=1)
        return names[finite], rows[finite]

    def run(batches):
        held = None
        for batch in batches:
            for at in range(len(batch)):
                if held is None:
                    known = tuple(of(batch, at, c, kind) for c, kind in (("a", np.int64), ("b", np.int64), ("d2", float)))
                    held = _Nearest(*points(batch, at, "keys", "data", "narrow"), k, None if known[0] is None else known)
                held.meet(*points(batch, at, "others", "other_data", "other_narrow"))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.found()], ["a", "b", "d2"])

    return run


def _nearest_by_block(k: int):
    """Pairs of blocks to a row of what is found for each run of pairs with the same block."""

    def run(batches):
        pairs = (batch.slice(at, 1) for batch in batches for at in range(len(batch)))
        for block, same in groupby(pairs, lambda row: row.column("block")[0].as_py()):
            for found in _nearest_of(k)(same):
                if len(found):
                    yield pa.RecordBatch.from_arrays(_row(block, [c.to_numpy() for c in found.columns]), ["block", "a", "b", "d2"])

    return run


def _merged(k: int, ranked: bool):
    """What several tasks found for a block as one row of the same kind, or as rows with their rank."""

    def run(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("a", np.int64), ("b", np.int64), ("d2", float)))
        a, b, d2 = _first(*parts, k)
        if not ranked:
            return pa.table(_row(group[0].as_py(), (a, b, d2)), ["block", "a", "b", "d2"])
        rank = np.arange(len(a)) - np.searchsorted(a, a) + 1
        return pa.table({"a": a, "rank": rank.astype(np.int32), "b": b, "d2": d2})

    return run


def knn(points: DataFrame, k: int, vector: str = "v", key: str = "id", block: int = 2_048, held: int = 64 << 20) -> DataFrame:
    """key, rank, neighbour, d2: the k nearest of every point, exactly, itself left out; ties go to the smaller key.

    Points are packed in blocks of about `block`, dealt by hash. A task holds `held` bytes of blocks and those of its partition on the
    other side meet them all; the partitions are read where they were written, so no copies of blocks are shuffled, and a task sends k rows a point.
    The blocks are met in rounds, each of up to eight times what came before it: those known by then bound what a task of a later round
    sends, so a round sends about 8 k rows a point, whatever the number of tasks.
    Exact neighbours cost the square of the number of points; `within` and the additive search are the ways beyond it.
    Vectors are of one length, with whole-number keys.
    """
    count, length = points.agg(F.count("*"), F.max(F.size(vector))).first()
    blocks = max(1, -(-count // block))
    together = max(1, held // (8 * block * max(1, length or 0)))
    tasks = -(-blocks // max(1, min(8, together, blocks // 64)))
    dealt = points.select(F.col(key).cast("long").alias(key), vector, F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"))

    def packed(low: int, high: int) -> DataFrame:
        parts = max(1, (high - low) * tasks // blocks)
        rows = dealt.where(F.col("block").between(low, high - 1)).repartitionByRange(parts, "block")
        return cut(rows.groupBy("block").applyInArrow(_packed(key, vector), PACKED)).coalesce(parts)

    ends = [0]
    while ends[-1] < blocks:
        ends.append(min(blocks, 8 * max(together, ends[-1])))
    rounds = [packed(low, high) for low, high in pairwise(ends)]
    own, best = reduce(DataFrame.union, rounds), None
    for met, size in zip(rounds, (high - low for low, high in pairwise(ends)), strict=True):
        others = met.select(F.col("keys").alias("others"), F.col("data").alias("other_data"), F.col("narrow").alias("other_narrow")).coalesce(-(-size // together))
        left = own
        if best is not None:
            left = cut(own.join(best, "block", "left").repartitionByRange(tasks, "block")).coalesce(tasks)
        found = left.crossJoin(others.hint("shuffle_replicate_nl")).mapInArrow(_nearest_by_block(k), FOUND)
        every = (found if best is None else found.unionByName(best)).groupBy("block")
        if met is not rounds[-1]:
            best = cut(every.applyInArrow(_merged(k, False), FOUND))
    ranked = every.applyInArrow(_merged(k, True), "a long, rank int, b long, d2 double")
    return ranked.select(F.col("a").alias(key), "rank", F.col("b").alias("neighbour"), "d2")
