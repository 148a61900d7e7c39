"""MinHash near-duplicates with bottom-k sketches from one hash function.

A text's set is its distinct shingles of `words` words (with fewer words, the whole sequence). Texts
with equal sets are one class, named by its smallest doc_id. A class's sketch holds the `k` smallest
hash values of its set. Inverted lists bring classes together. Single shingles are shared by chance
ever more often as a corpus grows, so lists are kept of neighbouring retained values (in the order of
the hash): a value that one of two sets lacks parts at most two neighbours, so similar sets have many
such pairs in common (`common`, but for one pair of texts in 1e8; for sketches that hold their whole
set the bound (2s - 1) n - 1 is exact), and unrelated texts next to none. It is enough that a class is
listed under the rarest of its pairs, as many as leave fewer than `common` out. Pairs that one class
alone has count among the rarest and need no list, and a class with fewer than `common` others leaves
before lists are made.

Within the lists no pair is emitted. A list's hub is its member with the smallest hash, and members of all lists
with one hub form its group; texts that share many lists share few hubs, so groups hold each text a few times. A
group is dealt into blocks, each with the hub. Inside a block the sketches' inverted lists give the overlaps, the
similarity of the union's sketch filters, the exact one on full sets verifies, and one link is kept for two trees
it joins. For groups of several blocks, members that are not in the group's commonest component are then held
against all its blocks; so links are never missed for a group's size, and a group that its hub connects costs its
length. Members that are similar to nothing cost a group's blocks squared.

Components are found by contraction, with checkpoints. Nothing but counts and flags reaches the driver.

Null and empty texts have an empty set, link to nothing and stay. Rows without doc_id link to nothing, stay, and
have no component. Rows that share a doc_id are one document: its texts' links count for all of them. Every input
row gives one row, an empty table none. Very long texts are hashed whole, as a block of their own. Only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethogrid.operators.graph import components, replaced, trees
from ethogrid.session import cut

from . import _bytes as B
from . import _shared as shared_values
from ._memory import freed


@dataclass(frozen=True)
class Params:
    words: int = 2
    percent: int = 80
    k: int = 128
    #: Pairs of neighbours that sketches of similar sets have in common: if the 128 smallest values of the union hold
    #: at most 53 that one set lacks (all but one pair in 1e8 at 80 %, fewer above), at least 127 - 2 * 53.
    common: int = 21
    #: Estimated similarity under which a pair is not verified: 0.8 less six deviations of the estimate.
    least: float = 0.58
    #: Members of a block.
    block: int = 512
    #: Links of a task that finds components.
    links: int = 1 << 20
    #: Buckets of classes at least, and classes in a bucket.
    buckets: int = 48
    bucket: int = 8_192


def shingles(buf: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, shingle fingerprint) pairs in order."""
    low = B.LOWER[buf]
    start, end, text = B.words(low, offsets)
    if not len(start):
        return text, np.zeros(0, np.uint64)
    word = B.fingerprint(B.prefix(low), start, end)
    value = word
    for j in range(1, words):
        value = B.pair(value[:-1], word[j:]) if len(value) > 1 else value[:0]
    full = text[: len(value)] == text[len(text) - len(value) :]
    owners, values = [text[: len(value)][full]], [value[full]]
    size = np.bincount(text, minlength=len(offsets) - 1)
    for k in np.flatnonzero((size > 0) & (size < words)):
        whole = word[text == k] if words > 8 else word[np.searchsorted(text, k) : np.searchsorted(text, k, "right")]
        one = whole[:1]
        for w in whole[1:]:
            one = B.pair(one, np.array([w]))
        owners.append(np.array([k]))
        values.append(B.mix(one ^ np.uint64(len(whole))))
    return B.distinct(np.concatenate(owners), np.concatenate(values))


def _cut_rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary rows of the values between bounds."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _sketcher(p: Params):
    def run(batches):
        for batch in batches:
            for low, high, buf, offsets in B.slices(batch.column("text")):
                text, value = shingles(buf, offsets, p.words)
                n = np.bincount(text, minlength=high - low)
                first = np.cumsum(n) - n
                rank = np.arange(len(text)) - first[text]
                key = [np.zeros(high - low, np.uint64), np.zeros(high - low, np.uint64)]
                for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(B.mix(value ^ np.uint64(salt)), dtype=np.uint64)])
                    key[k] = total[first + n] - total[first]
                keep = rank < p.k
                bounds = np.concatenate([[0], np.cumsum(np.minimum(n, p.k))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(n), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), _cut_rows(value[keep], bounds)],
                    ["doc_id", "n", "k1", "k2", "sketch"],
                )

    return run


def _sets(p: Params):
    """rep and the sorted full set of each text."""

    def run(batches):
        for batch in batches:
            for low, high, buf, offsets in B.slices(batch.column("text")):
                text, value = shingles(buf, offsets, p.words)
                bounds = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=high - low))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), _cut_rows(value, bounds)], ["rep", "all"])

    return run


def _neighbours(column) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of neighbouring values, their numbers) of binary rows of sorted values."""
    rows = column.to_pylist()
    value, sizes = np.frombuffer(b"".join(rows), np.uint64), np.array([len(x) // 8 for x in rows], np.int64)
    inner = np.ones(max(len(value) - 1, 0), bool)
    ends = np.cumsum(sizes)
    inner[ends[(ends > 0) & (ends < len(value))] - 1] = False
    return B.pair(value[:-1], value[1:])[inner], np.maximum(sizes - 1, 0)


def needed(n: np.ndarray, p: Params) -> np.ndarray:
    """How many pairs of neighbours a sketch of a set of n has in common with that of any similar set."""
    whole = -(-(n * (2 * p.percent - 100) - 100) // 100)
    return np.maximum(np.where(n * 100 < p.k * p.percent, whole, p.common), 1)


def _offer(shards: int):
    def run(batches):
        for batch in batches:
            value, sizes = _neighbours(batch.column("sketch"))
            yield shared_values.pack(np.repeat(batch.column("bucket").to_numpy(), sizes), value, np.repeat(batch.column("rep").to_numpy(), sizes), shards)

    return run


def _keep(shards: int, p: Params):
    """(value, rep, part, n, alone) of the shared values of the classes that have few enough unshared ones.

    Rows that repeat a rep's sketch count once; `part` tells the sets of one rep apart."""

    def run(key: tuple[pa.Scalar, ...], reps: pa.Table, answers: pa.Table) -> pa.Table:
        first: dict[tuple, int] = {}
        for k, x in enumerate(zip(*(reps.column(c).to_pylist() for c in ("rep", "n", "sketch")), strict=True)):
            first.setdefault(x, k)
        reps = reps.take(pa.array(list(first.values()), pa.int64()))
        value, sizes = _neighbours(reps.column("sketch"))
        shared = shared_values.among(shared_values.unpack(answers), value, shards)
        rep, n = reps.column("rep").to_numpy(), reps.column("n").to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        alone = sizes - np.bincount(row[shared], minlength=len(sizes))
        fit = shared & ((sizes - alone >= needed(n, p))[row])
        return pa.table({"value": value[fit].view(np.int64), "rep": rep[row[fit]], "part": row[fit], "n": n[row[fit]], "alone": alone[row[fit]]})

    return run


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(values, rows) of the sets, by value."""
    value, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    return value[order], row[order]


def overlaps(one: list[np.ndarray], two: list[np.ndarray], least: int = 64, part: int = 1 << 20) -> np.ndarray:
    """How many values each set of `one` has in common with each of `two`, from inverted lists of both.

    Lists with `least` pairs or more are counted by products of 0/1 matrices, the others pair by pair, in parts.
    """
    (va, ra), (vb, rb) = _flat(one), _flat(two)
    names = np.intersect1d(va, vb)
    at, bt = np.isin(va, names), np.isin(vb, names)
    ca, ra, cb, rb = np.searchsorted(names, va[at]), ra[at], np.searchsorted(names, vb[bt]), rb[bt]
    na, nb = np.bincount(ca, minlength=len(names)), np.bincount(cb, minlength=len(names))
    heavy = na * nb >= least
    out = np.zeros(len(one) * len(two), np.int64)
    few = np.flatnonzero(~heavy[ca])
    times, begin = nb[ca[few]], (np.cumsum(nb) - nb)[ca[few]]
    done = np.concatenate([[0], np.cumsum(times)])
    for low in np.arange(0, done[-1], part):
        i, j = np.searchsorted(done, [low, min(low + part, done[-1])])
        n = times[i:j]
        other = np.repeat(begin[i:j] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        out += np.bincount(np.repeat(ra[few[i:j]], n) * len(two) + rb[other], minlength=len(out))
    out = out.reshape(len(one), len(two))
    place = np.cumsum(heavy) - 1
    ca, ra, cb, rb = place[ca[heavy[ca]]], ra[heavy[ca]], place[cb[heavy[cb]]], rb[heavy[cb]]
    for low in range(0, int(heavy.sum()), 2048):
        sides = []
        for c, r, n in ((ca, ra, len(one)), (cb, rb, len(two))):
            i, j = np.searchsorted(c, [low, low + 2048])
            m = np.zeros((n, 2048), np.float32)
            m[r[i:j], c[i:j] - low] = 1
            sides.append(m)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def similar_pairs(one: list[np.ndarray], two: list[np.ndarray], p: Params) -> np.ndarray:
    """A row (i, j) for every pair of similar sets, exactly.

    The sketches' inverted lists give the overlaps; the union's sketch, all values up to the smaller of both sketches'
    ends, gives an estimate, and where some pass, the full sets' lists give the similarities.
    """
    sizes = [np.array([len(s) for s in x]) for x in (one, two)]
    low, high = np.minimum.outer(*sizes), np.maximum.outer(*sizes)
    sketches = [[s[: p.k] for s in x] for x in (one, two)]
    last = [np.array([s[-1] if len(s) == p.k else 0xFFFFFFFFFFFFFFFF for s in x], np.uint64) for x in sketches]
    overlap = overlaps(*sketches)
    fits = (overlap > 0) & (100 * low >= p.percent * high)
    if fits.any():
        inside = [np.stack([np.searchsorted(s, ends, "right") for s in x]) for x, ends in zip(sketches, last[::-1], strict=True)]
        fits &= overlap >= p.least * (inside[0] + inside[1].T - overlap)
    if not fits.any():
        return np.zeros((0, 2), np.int64)
    rows, columns = (np.flatnonzero(fits.any(axis=k)) for k in (1, 0))
    both = overlaps([one[k] for k in rows], [two[k] for k in columns])
    i, j = np.nonzero(fits[np.ix_(rows, columns)] & (100 * both >= p.percent * ((low + high)[np.ix_(rows, columns)] - both)))
    return np.column_stack([rows[i], columns[j]])


def _sets_of(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table.column("all").to_pylist()]


def _judge(p: Params):
    """A forest of the links within a block of a hub's group, or between loose members of one block and all of another."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        label, sets = table.column("label").to_numpy(), _sets_of(table)
        if "asks" in table.column_names:
            asks = table.column("asks").to_numpy(zero_copy_only=False)
            one, two = np.flatnonzero(asks), np.flatnonzero(~asks)
        else:
            one = two = np.arange(len(sets))
        pairs = similar_pairs([sets[k] for k in one], [sets[k] for k in two], p) if len(one) and len(two) else np.zeros((0, 2), np.int64)
        return pa.table(trees(label[one[pairs[:, 0]]], label[two[pairs[:, 1]]]), names=["a", "b"])

    return run


def _across(placed: DataFrame, labels: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Links between the blocks of groups that have several: members outside a group's commonest label against all."""
    known = placed.where("blocks > 1").select("hub", "rep", "own", "blocks", F.col("rep").alias("label"))
    known = cut(replaced(known, "label", labels))
    counts = known.groupBy("hub", "label").agg(F.count("*").alias("members"))
    open_ = counts.groupBy("hub").agg(F.max(F.struct("members", "label")).alias("top"), F.sum("members").alias("all"), F.count("*").alias("labels"))
    open_ = open_.where("labels > 1").select("hub", F.col("top.label").alias("top"), F.ceil((F.col("all") - F.col("top.members")) / p.block).alias("others"))
    known = known.join(open_, "hub")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    pool = known.select("hub", "rep", "label", F.lit(False).alias("asks"), F.col("own").alias("i"), F.explode(every("others")).alias("j"))
    asks = known.where("label <> top").withColumn("j", F.pmod(F.xxhash64("rep"), F.col("others")))
    asks = asks.select("hub", "rep", "label", F.lit(True).alias("asks"), F.explode(every("blocks")).alias("i"), "j")
    return pool.unionByName(asks).join(sets, "rep").groupBy("hub", "i", "j").applyInArrow(_judge(p), "a long, b long")


def _same_document(some: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links between the classes of doc_ids that stand for several texts; None without such doc_ids."""
    key = F.struct("k1", "k2", "n")
    several = cut(some.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low <> high").select("doc_id"))
    if several.isEmpty():
        return None
    return some.join(several, "doc_id").join(classes, ["k1", "k2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def near_duplicates(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = cut(rows.mapInArrow(freed(_sketcher(p)), "doc_id long, n long, k1 long, k2 long, sketch binary"))
    some = sketched.where("n > 0 and doc_id is not null")
    classes = cut(some.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")))
    shards = max(p.buckets, -(-classes.count() // p.bucket))
    reps = classes.select("rep", "n", "sketch", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("long").alias("bucket"))
    answers = shared_values.shared(reps.select("rep", "bucket", "sketch").mapInArrow(freed(_offer(shards)), shared_values.SCHEMA))
    values = reps.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_keep(shards, p), "value long, rep long, part long, n long, alone long")
    values = cut(values)
    # each list's length, and its hub: the member with the smallest hash, so that lists of like members have like hubs
    counts = values.groupBy("value").agg(F.count("*").alias("df"), F.min(F.struct(F.xxhash64("rep").alias("hash"), "rep")).alias("low"))
    size, by_rep = F.least("n", F.lit(p.k)) - 1, Window.partitionBy("rep", "part")
    whole = F.ceil((F.col("n") * (2 * p.percent - 100) - 100) / 100)
    wanted = F.greatest(F.when(F.col("n") * 100 < p.k * p.percent, whole).otherwise(p.common), F.lit(1))
    ranked = values.join(counts, "value").withColumn("rank", F.row_number().over(by_rep.orderBy("df", "value")) + F.col("alone"))
    listed = ranked.where((F.col("rank") <= size - wanted + 1) & (F.col("df") > 1)).select(F.col("low.rep").alias("hub"), "rep")
    group = cut(listed.distinct())
    members = group.groupBy("hub").agg((F.ceil((F.count("*") + 1) / p.block)).alias("blocks"))
    placed = group.where("hub <> rep").join(members, "hub").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    placed = placed.unionByName(members.select("hub", F.col("hub").alias("rep"), "blocks", F.lit(0).cast("long").alias("own")))
    placed = cut(placed)
    sets = rows.join(placed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").dropDuplicates(["doc_id", "text"])
    sets = cut(sets.mapInArrow(freed(_sets(p)), "rep long, all binary"))
    inside = placed.select("hub", "rep", F.explode(F.when(F.col("hub") == F.col("rep"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("own"))).alias("i"))
    links = inside.join(sets, "rep").withColumnRenamed("rep", "label").groupBy("hub", "i").applyInArrow(_judge(p), "a long, b long")
    same = _same_document(some, classes)
    labels = components(links if same is None else links.unionByName(same), p.links)
    across = components(_across(placed, labels, sets, p), p.links)
    named = replaced(replaced(classes.select("k1", "k2", "n", F.col("rep").alias("label")), "label", labels), "label", across)
    return (
        sketched.select("doc_id", "n", "k1", "k2")
        .join(named, ["k1", "k2", "n"], "left")
        .withColumn("component_id", F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("label"))).otherwise(F.col("doc_id")))
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
