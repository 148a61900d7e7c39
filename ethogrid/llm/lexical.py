"""Ranked lexical search as a blocked sparse matrix product.

Items by terms, times terms by documents, in whole numbers. Each block of documents (some megabytes of
text) is a sparse matrix with a dictionary of its own; items come in blocks of a fixed number. Blocks
meet by number, and a product is made row by row: the rows of the terms of an item are merged into one
row of sums over the block's documents, of which the highest stay. What stays is merged from block to
block within a task and then over all tasks, so no more than `near` documents an item and task travel.

A term's occurrences are counted in its document before anything is dealt, so a frequent term is one
row a block in the counts of documents, and a long or hot document is one column of one block. Blocks of
documents hold the terms of items alone where those fit into `known` bytes, by a check; else all terms.

Documents without a doc_id count and rank like others, after those of equal score; repeated rows rank
each. Items: rows with one item_id are one item with the terms of all; those without an item_id ask
nothing. Null and empty texts have no terms; a text may have any length and is read whole (a task needs some twelve times
its longest). Empty tables on either side give no rows. Only doc_id, item_id and text are read, so other columns
may have any name. Sums are 64-bit: fifty times the terms of the longest document times the documents must stay below 2**63.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethogrid.session import cut

from . import _bytes as B
from ._memory import freed

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that stand in no term: those below 128 but digits and letters.
OUTSIDE = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
NO_ID = np.iinfo(np.int64).max
BLOCK = "documents long, terms long, n_terms long, columns binary, dictionary binary, matrix binary, df array<long>, words array<string>"
FOUND = "item_id long, doc_id long, score long"


@dataclass(frozen=True)
class Params:
    near: int = 50
    #: Items of a block, bytes of text of a block of documents.
    items: int = 1024
    text: int = 1 << 22
    #: Bytes of terms, and of packed items, that are sent to every task; beyond that they are joined.
    known: int = 16 << 20
    #: A term counts once an item, or else as often as it stands there.
    once: bool = True


def item_terms(items: DataFrame, once: bool = True) -> DataFrame:
    """item_id, term and times, the rows of the items' matrix."""
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    each = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    return each.groupBy("item_id", "term").agg((F.lit(1) if once else F.count("*")).cast("long").alias("times"))


def _zipped(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(a.astype(np.int32).tobytes() for a in arrays), 1)


def _matrix(buf: np.ndarray, offsets: np.ndarray, known: pa.Array | None) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text; the dictionary; and by term and text: term, text, occurrences."""
    buf = B.LOWER[buf]
    start, end, owner = B.words(buf, offsets, OUTSIDE)
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    data = buf[~OUTSIDE[buf]]
    ends = np.concatenate([[0], np.cumsum(end - start)])
    coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy()
    if known is not None:
        kept = pc.is_in(words, value_set=known).to_numpy(zero_copy_only=False)
        number = np.cumsum(kept) - 1
        here = kept[code]
        code, owner, words = number[code[here]], owner[here], words.filter(pa.array(kept))
    pair, times = np.unique(code.astype(np.int64) * len(counts) + owner, return_counts=True)
    return counts, words, pair // len(counts), pair % len(counts), times


def _blocks(p: Params, known: pa.Array | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy()
            for low, high, buf, offsets in B.slices(batch.column("text"), p.text):
                counts, words, term, text, times = _matrix(buf, offsets, known)
                rows = np.searchsorted(term, np.arange(len(words) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int((counts > 0).sum())]),
                        pa.array([int(counts.sum())]),
                        pa.array([len(words)]),
                        pa.array([docs[low:high].tobytes() + counts.astype(np.int64).tobytes()], pa.binary()),
                        pa.array([zlib.compress("\n".join(words.to_pylist()).encode(), 1)], pa.binary()),
                        pa.array([_zipped(rows, text, times)], pa.binary()),
                        pa.array([np.diff(rows).tolist()], pa.list_(pa.int64())),
                        pa.array([words.to_pylist()], pa.list_(pa.string())),
                    ],
                    ["documents", "terms", "n_terms", "columns", "dictionary", "matrix", "df", "words"],
                )

    return run


def _packed(table: pa.Table) -> pa.Table:
    """A block of items: ids, where each one's terms begin, terms, weights times multiplicities."""
    table = table.sort_by([("item_id", "ascending"), ("term", "ascending")])
    ids, first = np.unique(table.column("item_id").to_numpy(), return_index=True)
    words = table.column("term").combine_chunks().dictionary_encode()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    data = [ids.astype(np.int64), np.append(first, len(table)).astype(np.int64), words.indices.to_numpy().astype(np.int64), table.column("weight").to_numpy().astype(np.int64)]
    out = {name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("ids", "first", "codes", "weights"), data, strict=True)}
    return pa.table({"block": table.column("block")[:1]} | out | {"known": pa.array(["\n".join(words.dictionary.to_pylist()).encode()], pa.binary())})


def _lines(data: bytes) -> pa.Array:
    return pa.array(data.decode().split("\n") if data else [], pa.large_string())


class Items:
    """A block of items, and the best documents so far of each."""

    def __init__(self, row: dict, near: int):
        self.ids, self.first, self.codes, self.weights = (np.frombuffer(row[c], np.int64) for c in ("ids", "first", "codes", "weights"))
        self.known, self.near = _lines(row["known"]), near
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(self.ids)

    def product(self, row: dict, n_docs: int, n_terms: int) -> None:
        """Times one block of documents."""
        docs, counts = np.frombuffer(row["columns"], np.int64).reshape(2, -1)
        flat = np.frombuffer(zlib.decompress(row["matrix"]), np.int32)
        first = flat[: row["n_terms"] + 1]
        text, times = flat[row["n_terms"] + 1 :].reshape(2, -1).astype(np.int64)
        m = 50 + (50 * counts * n_docs) // max(n_terms, 1)
        impact = (1_000_000_000 * times) // (1000 * times + 20 * m[text])
        place = pc.fill_null(pc.index_in(self.known, value_set=_lines(zlib.decompress(row["dictionary"]))), -1).to_numpy(zero_copy_only=False)
        place = place[self.codes]
        sums = np.zeros(len(docs), np.int64)
        for k in range(len(self.ids)):
            low, high = self.first[k], self.first[k + 1]
            sums[:] = 0
            for t, w in zip(place[low:high].tolist(), self.weights[low:high].tolist(), strict=True):
                if t >= 0 and w:
                    i, j = first[t], first[t + 1]
                    sums[text[i:j]] += w * impact[i:j]  # a document stands once in a term's row
            held = self.best[k]
            edge = held[0][-1] if len(held[0]) == self.near else 1
            at = np.flatnonzero(sums >= max(edge, 1))
            if len(at):
                score, ids = np.concatenate([held[0], sums[at]]), np.concatenate([held[1], docs[at]])
                order = np.lexsort((ids, -score))[: self.near]
                self.best[k] = score[order], ids[order]

    def found(self) -> pa.RecordBatch:
        size = [len(s) for s, _ in self.best]
        score, ids = (np.concatenate([x[k] for x in self.best]) if size else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, size)), pa.array(ids, mask=ids == NO_ID), pa.array(score)], ["item_id", "doc_id", "score"])


def _products(near: int, n_docs: int, n_terms: int):
    """Of a task's pairs of blocks, the best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Items | None = None
        block = None
        for batch in batches:
            for k in range(len(batch)):
                number = batch.column("block")[k].as_py()
                if held is None or number != block:
                    if held is not None:
                        yield held.found()
                    block, held = number, Items({c: batch.column(c)[k].as_py() for c in ("ids", "first", "codes", "weights", "known")}, near)
                held.product({c: batch.column(c)[k].as_py() for c in ("columns", "matrix", "dictionary", "n_terms")}, n_docs, n_terms)
        if held is not None:
            yield held.found()

    return run


def search(items: DataFrame, documents: DataFrame, p: Params = Params()) -> DataFrame:
    """item_id, rank, doc_id and score of the p.near highest-scoring documents of each item."""
    spark = documents.sparkSession
    wanted = cut(item_terms(items, p.once))
    words = wanted.select("term").distinct()
    size = words.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    known = pa.array([r.term for r in words.collect()], pa.large_string()) if size <= p.known else None
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = cut(rows.mapInArrow(freed(_blocks(p, known)), BLOCK))
    n_docs, n_terms = (x or 0 for x in blocks.agg(F.sum("documents"), F.sum("terms")).first())
    df = blocks.select(F.explode(F.arrays_zip("words", "df")).alias("x")).groupBy(F.col("x.words").alias("term")).agg(F.sum("x.df").alias("df"))
    n_items = wanted.select("item_id").distinct().count()
    if not n_items or not n_docs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    n_blocks = -(-n_items // p.items)
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2.0 * F.col("df") + 1))) * F.col("times")
    weighted = wanted.join(df, "term").select(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).alias("block"), "item_id", "term", weight.cast("long").alias("weight"))
    packed = cut(weighted.groupBy("block").applyInArrow(_packed, "block long, ids binary, first binary, codes binary, weights binary, known binary"))
    sent = packed.agg(F.sum(sum(F.octet_length(c) for c in ("ids", "first", "codes", "weights", "known")))).first()[0] or 0
    columns = blocks.select("columns", "matrix", "dictionary", "n_terms").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    if sent <= p.known:
        pairs = columns.join(F.broadcast(packed), "block")
    else:  # a block of items goes to several tasks, and with it a share of the blocks of documents
        share = max(1, -(-blocks.rdd.getNumPartitions() // n_blocks))
        dealt = columns.withColumn("share", F.pmod(F.xxhash64("columns"), F.lit(share)))
        spread = packed.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(share - 1).cast("long"))))
        pairs = dealt.join(spread.hint("merge"), ["block", "share"])
    best = pairs.sortWithinPartitions("block").mapInArrow(freed(_products(p.near, n_docs, n_terms)), FOUND)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.near)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
