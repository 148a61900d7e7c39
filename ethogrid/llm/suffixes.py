"""Exact substring duplicates by a logarithmic family of suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller
doc_id. The suffix arrays are sparse: among the `seed`-byte strings of each window of `length` bytes
the one with the smallest fingerprint is the window's anchor, so equal windows have equal anchors at
equal places and only suffixes near anchors need to meet. The work is dealt by anchor string, in
shards. Suffixes are in the order of their first `length` bytes, and only equal bytes count as equal.

1. Anchors of every document are sent to their shard as 4-byte values, which tells those that more
   than one document holds (or seems to hold; chance hits do no harm).
2. For these, each bucket of documents sends every distinct surrounding, in bytes, with its smallest
   document, to the shard. Of surroundings with equal bytes the smallest document's stands for all.
   A shard takes them in batches of rising doc_id. A batch gets its suffix array, is merge-scanned
   against the levels of the index (all smaller documents) for common prefixes of `length` bytes and
   becomes the lowest level; levels of like size are merged, so n batches leave about log n levels.
3. Each bucket gets its surroundings' windows back as bit masks and cuts its documents.

A string that very many documents hold is one value a bucket in step 1 and one surrounding a bucket
in step 2, so no shard gets more of it than there are buckets. Buckets and shards grow in number with
the input and hold about `target` bytes of text each. Nothing is taken from the driver but one sum.

Null texts are empty; texts under `length` bytes lose nothing. Rows without doc_id lose nothing and
no other row loses by them. Rows with one doc_id count as one document: they lose nothing to each
other. Repeated rows give equal results, one for each row. An empty table gives no rows. Very long
texts are worked on whole, in one task each. Of the other columns only those to carry are read, so
they may have any name but those of the result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid.session import cut

from . import _bytes as B
from . import _shared as shared_values
from ._memory import freed, released

#: Bytes of text whose anchors are sought, or which are cut, at a time: some 20 arrays of numbers a byte lie beside them.
SLICE = 1 << 18


@dataclass(frozen=True)
class Params:
    length: int = 50
    seed: int = 25
    #: Bytes of text in a bucket, and in the share of a shard.
    target: int = 12 << 20
    least: int = 48
    #: Bytes of surroundings that make a batch of a shard.
    batch: int = 4 << 20


@dataclass
class Anchors:
    """The anchors of a run of texts: place, first and last window, text number and fingerprint of the seed."""

    sums: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    seed: np.ndarray


def anchors(buf: np.ndarray, offsets: np.ndarray, p: Params) -> Anchors:
    sums = B.prefix(buf)
    n, span = len(buf), p.length - p.seed + 1
    none = np.zeros(0, np.int64)
    if n < p.length:
        return Anchors(sums, none, none, none, none, np.zeros(0, np.uint64))
    seed = B.fingerprints(sums, p.seed)
    bits = np.uint64(max(n.bit_length(), 1))
    low = seed >> bits << bits
    low |= np.arange(len(seed), dtype=np.uint64)  # the leftmost of equal ones is the smallest
    reach = 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    sizes = np.diff(offsets)
    inside = np.ones(n, bool)  # but for windows that reach beyond their text
    tails = np.minimum(sizes, p.length - 1)
    inside[np.repeat(offsets[1:] - np.cumsum(tails), tails) + np.arange(int(tails.sum()))] = False
    window = np.flatnonzero(inside[: len(low)])
    place = (low[window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1])])) if len(place) else none
    text = np.searchsorted(offsets, window[new], "right") - 1
    stop = np.append(new[1:], len(window)) - 1
    return Anchors(sums, place[new], window[new], window[stop] if len(new) else none, text, seed[place[new]])


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id or 0, whether it is there)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ~column.is_null().to_numpy(zero_copy_only=False)


def _runs(buckets: np.ndarray, size: np.ndarray, part: int) -> list[np.ndarray]:
    """Rows of whole buckets, about `part` bytes of text at a time."""
    order = np.argsort(buckets, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], np.diff(buckets[order]) != 0])) if len(order) else order
    return [order[new[i] : new[j] if j < len(new) else None] for i, j in _parts(np.add.reduceat(size[order], new) if len(new) else new, part)]


def _seeds(shards: int, p: Params):
    """Step 1, on texts: (shard, bucket, values); a value is 31 bits of a seed and whether several documents hold it.

    A batch may hold many MB of text, so its buckets are worked on a few at a time.
    """

    def packed(texts: pa.RecordBatch) -> pa.RecordBatch:
        ids, there = _ids(texts.column("doc_id"))
        buckets = texts.column("bucket").to_numpy()
        parts = []
        for low, high, buf, offsets in B.slices(texts.column("text"), SLICE):
            a = anchors(buf, offsets, p)
            ok = there[low:high][a.text]
            parts.append((buckets[low:high][a.text[ok]], a.seed[ok], ids[low:high][a.text[ok]]))
        return shared_values.pack(*(np.concatenate(x) for x in zip(*parts, strict=True)), shards)

    def run(batches):
        for batch in batches:
            size = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for rows in _runs(batch.column("bucket").to_numpy(), size, p.batch):
                yield packed(batch.take(pa.array(rows)))

    return run


@dataclass
class Surroundings:
    """The shared anchors of a bucket's texts, and their distinct surroundings.

    For each anchor, in the order of the texts: its first window, how many windows, text and entry; for each
    entry, in the order in which shards get them: shard, smallest document and an anchor that has both.
    """

    buf: np.ndarray
    offsets: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    text: np.ndarray
    entry: np.ndarray
    shard: np.ndarray
    smallest: np.ndarray
    sample: np.ndarray


def surroundings(texts: pa.Table, ids: np.ndarray, there: np.ndarray, known: np.ndarray, shards: int, p: Params) -> Surroundings:
    """ids, there: the texts' doc_id and whether they have one; known: the bucket's shared anchors, unpacked."""
    whole, bounds = B.utf8(texts.column("text"))
    rows = [tuple(np.zeros(0, t) for t in (np.int64, np.uint8, np.int32, np.int32, np.uint64))]
    for low, high, buf, offsets in B.cuts(whole, bounds, SLICE) if len(known) else ():
        a = anchors(buf, offsets, p)
        ok = np.flatnonzero(there[low:high][a.text] & shared_values.among(known, a.seed, shards))
        first, seed = a.first[ok], a.seed[ok]
        content = B.pair(B.fingerprint(a.sums, first, a.last[ok] + p.length), seed + (a.place[ok] - first).astype(np.uint64))
        shard = shared_values.shard_of(seed, shards).astype(np.int32)
        rows.append((first + bounds[low], (a.last[ok] - first + 1).astype(np.uint8), (a.text[ok] + low).astype(np.int32), shard, content))
    first, windows, text, shard, content = (np.concatenate(x) for x in zip(*rows, strict=True))
    del rows
    order = np.lexsort((ids[text], content, shard))
    new = np.ones(len(order), bool)
    shard, content = shard[order], content[order]
    new[1:] = (content[1:] != content[:-1]) | (shard[1:] != shard[:-1])
    entry = np.zeros(len(order), np.int32)
    entry[order] = np.cumsum(new, dtype=np.int32) - 1
    sample = order[new]
    return Surroundings(whole, bounds, first, windows, text, entry, shard[new], ids[text[sample]], sample)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array | pa.ChunkedArray:
    """Values that lie one after another in the data, of which no copy is made."""
    if ends[-1] >= 1 << 31:
        return pa.array([data[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _sender(shards: int, p: Params):
    """Step 2, on buckets: (shard, bucket, docs, sizes, data) of the distinct surroundings."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, shared: pa.Table) -> pa.Table:
        s = surroundings(texts, *_ids(texts.column("doc_id")), shared_values.unpack(shared), shards, p)
        size = s.windows[s.sample].astype(np.int64) + p.length - 1
        out, _ = _gathered(s.buf, s.first[s.sample], size)
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.flatnonzero(np.concatenate([[True], s.shard[1:] != s.shard[:-1]])) if len(s.shard) else np.zeros(0, np.int64)
        bounds = np.append(at, len(s.shard))
        return pa.table(
            {
                "shard": pa.array(s.shard[at], pa.int64()),
                "bucket": pa.array([key[0].as_py()] * len(at), pa.int64()),
                "docs": _binary(s.smallest.view(np.uint8), bounds * 8),
                "sizes": _binary(size.astype(np.uint8), bounds),
                "data": _binary(out, ends[bounds]),
            }
        )

    return run


def _words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number, so that numbers are in the order of the bytes."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[at + k].astype(np.uint64)
    return out


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes that begin at `at`, by their first `length` bytes; which differ there from the one before).

    Eight bytes decide at first, and eight more each time for suffixes that are still alike, whose common prefix is
    thus known to grow; what remains alike has `length` bytes in common. Ties keep their order. Runs that are sorted
    already, as two levels beside each other are, are merged and not sorted anew.
    """
    key = _words_at(data, at)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    for step in [*range(8, length - 7, 8), *([length - 8] if length % 8 else [])]:
        alike = ~new
        alike[:-1] |= alike[1:]
        tied = np.flatnonzero(alike)
        if not len(tied):
            break
        run, sub = np.cumsum(new)[tied], order[tied]
        key = _words_at(data, at[sub] + step)
        by = np.lexsort((key, run))
        order[tied], key = sub[by], key[by]
        new[tied[1:]] |= (run[1:] == run[:-1]) & (key[1:] != key[:-1])
    return order, new


class Levels:
    """A logarithmic family of sparse suffix arrays, each at least twice as long as the next: bytes, and places in order.

    A level's suffixes differ from each other, and from those of other levels, in their first `length` bytes.
    """

    def __init__(self, length: int):
        self.length, self.arrays = length, []

    def _merged(self, one: tuple, two: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data, at = np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1] + len(one[0])])
        return data, at, *suffix_order(data, at, self.length)

    def holds(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the batch's suffixes, sorted and distinct, some level has: each level is merged with the batch and scanned."""
        found = np.zeros(len(at), bool)
        for level in self.arrays:
            _, _, order, new = self._merged(level, (data, at))
            second = order[1:][~new[1:]]  # of two suffixes that are alike the level's comes first
            found[second - len(level[1])] = True
        return found

    def add(self, data: np.ndarray, at: np.ndarray) -> None:
        if len(at):
            self.arrays.append((data, at))
        while len(self.arrays) > 1 and len(self.arrays[-2][1]) < 2 * len(self.arrays[-1][1]):
            top, under = self.arrays.pop(), self.arrays.pop()
            data, at, order, _ = self._merged(under, top)
            self.arrays.append((data, at[order]))


def _gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the pieces of the data one after another, where each begins there)."""
    ends = np.cumsum(size)
    start, out = ends - size, np.empty(int(size.sum()), data.dtype)
    for i, j in _parts(size, SLICE):  # the bytes' places are eight times as large as the bytes
        low, high = start[i], ends[j - 1]
        out[low:high] = data[np.repeat(begin[i:j] - start[i:j], size[i:j]) + np.arange(low, high)]
    return out, start


def _parts(size: np.ndarray, part: int) -> list[tuple[int, int]]:
    """(first, last + 1) of runs of pieces of about `part` bytes."""
    ends = np.cumsum(size)
    cuts = np.flatnonzero(np.diff(ends // part)) + 1
    return list(zip([0, *cuts], [*cuts, len(size)], strict=True)) if len(size) else []


def _twins(data: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, part: int) -> np.ndarray:
    """For each piece, the piece with equal bytes that has the smallest document (ties: that comes first)."""
    name = np.zeros(len(size), np.uint64)
    for i, j in _parts(size, part):
        whole, start = _gathered(data, begin[i:j], size[i:j])
        name[i:j] = B.pair(B.fingerprint(B.prefix(whole), start, start + size[i:j]), size[i:j].astype(np.uint64))
    order = np.lexsort((doc, name))
    like = np.flatnonzero(name[order][1:] == name[order][:-1]) + 1
    same = np.ones(len(like), bool)
    for i, j in _parts(size[order[like]], part):  # fingerprints propose, bytes decide
        at, before = order[like[i:j]], order[like[i:j] - 1]
        (one, start), (two, _) = _gathered(data, begin[at], size[at]), _gathered(data, begin[before], size[at])
        same[i:j] = np.logical_and.reduceat(one == two, start)
    first = np.arange(len(order))
    first[like[same]] = 0
    out = np.empty(len(order), np.int64)
    out[order] = order[np.maximum.accumulate(first)]
    return out


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers in all rows of a binary column, without a copy of one chunk; the rows' bounds in them)."""
    rows = column.combine_chunks().cast(pa.large_binary())
    rows = rows if isinstance(rows, pa.Array) else pa.concat_arrays(rows.chunks)
    _, offsets, data = rows.buffers()
    offsets = np.frombuffer(offsets, np.int64)[rows.offset : rows.offset + len(rows) + 1]
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind), (offsets - offsets[0]) // width


def _matcher(p: Params):
    """Step 2, on shards: for each bucket's entries, masks of the windows that a smaller document holds."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        doc, bounds = _flat(table.column("docs"), np.int64)
        size = _flat(table.column("sizes"), np.uint8)[0].astype(np.int64)
        data = _flat(table.column("data"), np.uint8)[0]
        begin = np.cumsum(size) - size
        masks = np.zeros(len(doc), np.uint32)
        twin = _twins(data, begin, size, doc, min(p.batch, SLICE))
        masks[doc > doc[twin]] = 0xFFFFFFFF  # a smaller document has all of the piece
        own = np.flatnonzero(twin == np.arange(len(doc)))
        own = own[np.argsort(doc[own], kind="stable")]
        fresh = np.flatnonzero(np.concatenate([[True], doc[own][1:] != doc[own][:-1]]))  # a document stays in one batch
        bytes_before = (np.cumsum(size[own]) - size[own])[fresh]
        starts = fresh[np.flatnonzero(np.concatenate([[True], bytes_before[1:] // p.batch != bytes_before[:-1] // p.batch]))]
        levels = Levels(p.length)
        for low, high in zip(starts, np.append(starts[1:], len(own)), strict=True):
            mine = own[low:high]
            part, start = _gathered(data, begin[mine], size[mine])
            windows = size[mine] - p.length + 1
            owner = np.repeat(np.arange(len(mine)), windows)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            at = start[owner] + step
            order, new = suffix_order(part, at, p.length)  # stable: documents rise within equal suffixes
            owner, step, at = owner[order], step[order], at[order]
            first = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            known = levels.holds(part, at[first])
            gone = known[run_of] | (doc[mine][owner] > doc[mine][owner[first]][run_of])
            np.bitwise_or.at(masks, mine[owner[gone]], np.uint32(1) << step[gone].astype(np.uint32))
            levels.add(part, at[first][~known])
        masks[doc == doc[twin]] = masks[twin][doc == doc[twin]]
        data = [masks[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table({"bucket": table.column("bucket"), "shard": pa.array([key[0].as_py()] * len(data), pa.int64()), "data": pa.array(data, pa.binary())})

    return run


def _cutter(shards: int, p: Params, carry: tuple[str, ...], with_text: bool):
    """Step 3, on buckets. The rows leave in chunks of about SLICE bytes of text, so that no side holds a bucket's results at once."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, answers: pa.Table) -> pa.Table:
        kind = answers.column("kind").to_numpy() if len(answers) else np.zeros(0)
        ids, there = _ids(texts.column("doc_id"))
        s = surroundings(texts, ids, there, shared_values.unpack(answers.filter(pa.array(kind == 1))), shards, p)
        got = answers.filter(pa.array(kind == 2))
        got = got.take(np.argsort(got.column("shard").to_numpy(), kind="stable")) if len(got) else got
        masks = np.concatenate([np.zeros(0, np.uint32), *(_flat(x, np.uint32)[0] for x in [got.column("data")] if len(got))])
        mask = np.where(ids[s.text] == s.smallest[s.entry], masks[s.entry], np.uint32(0xFFFFFFFF)) if len(s.entry) else masks
        columns: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "text": []}
        for low, high, buf, offsets in B.cuts(s.buf, s.offsets, SLICE):
            base = s.offsets[low]
            i, j = np.searchsorted(s.first, [base, s.offsets[high]])
            windows = s.windows[i:j].astype(np.int64)
            step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
            hit = (np.repeat(mask[i:j], windows) >> step.astype(np.uint32)) & np.uint32(1) == 1
            gone = np.zeros(len(buf) + 1, np.int64)
            gone[1:][(np.repeat(s.first[i:j] - base, windows) + step)[hit]] = 1
            gone = np.cumsum(gone)
            covered = gone[1:].copy()
            covered[p.length :] -= gone[1 : len(covered) - p.length + 1] if len(covered) > p.length else 0
            covered = covered > 0
            begins = covered.copy()
            begins[1:] &= ~covered[:-1]
            inner = offsets[:-1][np.diff(offsets) > 0]
            begins[inner] = covered[inner]
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])  # noqa: B023,E731
            removed = total(covered)
            left, ends = buf[~covered].tobytes(), np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).tolist()
            kept = [left[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
            for c, x in (("n_bytes", np.diff(offsets)), ("n_removed", removed), ("n_spans", total(begins))):
                columns[c].append(pa.array(x, pa.int64()))
            columns["kept_sha256"].append(pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))
            if with_text:
                columns["text"].append(pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()))
        numbers = {c: pa.chunked_array(columns[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}
        out = {"doc_id": texts.column("doc_id"), **numbers, "kept_sha256": pa.chunked_array(columns["kept_sha256"], pa.string())}
        if with_text:
            out["text"] = pa.chunked_array(columns["text"], pa.string())
        return pa.table(out | {c: texts.column(c) for c in carry})

    return run


def substring_dedup(documents: DataFrame, p: Params = Params(), carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; on request what is left as text, and other columns.

    Bytes of a character of which another byte went don't show in the text, only in the digest.
    """
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(p.least, -(-size // p.target))
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64(key), F.lit(shards)).cast("long").alias("bucket"), *carry)
    plain = texts.select("doc_id", "text", "bucket")
    found = plain.mapInArrow(freed(_seeds(shards, p)), "shard long, bucket long, data binary")
    shared = cut(shared_values.shared(found))
    by_bucket = texts.groupBy("bucket")
    sent = by_bucket.cogroup(shared.groupBy("bucket")).applyInArrow(released(_sender(shards, p), 3), "shard long, bucket long, docs binary, sizes binary, data binary")
    masks = sent.groupBy("shard").applyInArrow(released(_matcher(p), 2), "bucket long, shard long, data binary")
    answers = shared.withColumn("kind", F.lit(1)).unionByName(masks.withColumn("kind", F.lit(2)))
    kinds = dict(documents.dtypes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text + "".join(f", `{c}` {kinds[c]}" for c in carry)
    return by_bucket.cogroup(answers.groupBy("bucket")).applyInArrow(released(_cutter(shards, p, carry, with_text), 3), schema)
