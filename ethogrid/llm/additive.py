"""Approximate nearest neighbours by additive quantisation, with exact reranking.

A unit vector is coded as a sum of `books` full-dimensional codewords, one of each codebook. The
codebooks are trained one after another on the residuals of a bounded sample (Params.sample vectors
with the smallest hashed ids); a vector's code is found by a beam search over all books and stored
with its reconstruction's norm. A query's inner products with all codewords make a look-up table;
codes are scored by summing table entries over their stored norm, and the `shortlist` best of a query
are reranked by the exact cosine of the original vectors in double precision.

Equal vectors are indexed once, with the `near` + 1 smallest of their ids: no others of them can be
among a query's nearest, as ties go to the smaller id. So a vector with a third of all rows is one
entry. Codes are scanned in packed blocks, each against packed blocks of queries; every pair of
blocks meets once, dealt by the pair, so tasks are as many as pairs up to Params.tasks, and sends `shortlist` entries a
query. With a shortlist of as many entries as there are vectors the search is exact.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without vec_id take
no part. Vectors of different lengths have no cosine: each length is searched by itself, with codebooks of
its own. Of rows with one vec_id the smallest vector counts. Without at least two vectors of a length it gives no
rows. Very long vectors make larger codebooks (`books` * `words` vectors). Only vec_id and embedding are read, so
other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethogrid.session import cut

from ._memory import freed


SCHEMA = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class Params:
    books: int = 16
    words: int = 256
    sample: int = 16_384
    turns: int = 8
    beam: int = 4
    shortlist: int = 384
    near: int = 5
    query_block: int = 64
    code_block: int = 65_536
    every: int = 50
    #: Tasks of the scan at most.
    tasks: int = 2048


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part, one row an id."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(~F.exists("v", odd) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def train(sample: np.ndarray, p: Params) -> np.ndarray:
    """Codebooks (books, words, dimensions) of unit vectors: k-means on what the earlier books leave over."""
    rng, rest, books = np.random.default_rng(7), sample.astype(np.float32).copy(), []
    for _ in range(p.books):
        centres = rest[rng.choice(len(rest), p.words, replace=len(rest) < p.words)].copy()
        for _ in range(p.turns):
            near = np.argmax(rest @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
            count = np.bincount(near, minlength=p.words)
            total = np.zeros_like(centres)
            np.add.at(total, near, rest)
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], rest[rng.choice(len(rest), p.words)])
        near = np.argmax(rest @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
        rest = rest - centres[near]
        books.append(centres)
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, norms of the reconstructions) by a beam search."""
    n, (m, k, d) = len(x), books.shape
    rest = x[:, None, :].astype(np.float32)
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books:
        # the squared length of the residual after each codeword, less what all share
        cost = ((rest * rest).sum(axis=2)[:, :, None] - 2 * (rest @ book.T) + (book * book).sum(axis=1)).reshape(n, -1)
        width = min(beam, cost.shape[1])
        best = np.argpartition(cost, width - 1, axis=1)[:, :width]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(cost, best, axis=1), axis=1, kind="stable"), axis=1)
        parent, word = best // k, best % k
        rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
    return codes[:, 0], np.linalg.norm(x - rest[:, 0], axis=1).astype(np.float32)


def _matrix(column: pa.ListArray) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _coder(books: np.ndarray, p: Params):
    """vec_id, code and norm of every vector."""

    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), 1024):
                part = batch.slice(low, 1024)
                code, norm = encode(_matrix(part.column("v")), books, p.beam)
                rows = pa.array([c.tobytes() for c in np.ascontiguousarray(code)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), rows, pa.array(norm.astype(np.float32))], ["vec_id", "code", "norm"])

    return run


def _pack_codes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A block of codes: ids, codes, norms."""
    data = [table.column("vec_id").to_numpy().tobytes(), b"".join(table.column("code").to_pylist()), table.column("norm").to_numpy().astype(np.float32).tobytes()]
    return pa.table({"share": pa.array([key[0].as_py()], pa.int64())} | {c: pa.array([x], pa.binary()) for c, x in zip(("ids", "codes", "norms"), data, strict=True)})


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A block of queries: ids and unit vectors."""
    data = [table.column("vec_id").to_numpy().tobytes(), _matrix(table.column("v").combine_chunks()).tobytes()]
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "queries": pa.array(data[:1], pa.binary()), "vectors": pa.array(data[1:], pa.binary())})


def _scanner(books: np.ndarray, p: Params):
    """The shortlist of each query of a block within a block of codes."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                queries, ids = np.frombuffer(row["queries"], np.int64), np.frombuffer(row["ids"], np.int64)
                vectors = np.frombuffer(row["vectors"], np.float32).reshape(len(queries), -1)
                codes, norms = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["norms"], np.float32)
                order = np.argsort(ids, kind="stable")  # so that the smaller id wins ties
                ids, codes, norms = ids[order], np.ascontiguousarray(codes[order].T), np.maximum(norms[order], 1e-6)
                table = np.einsum("qd,mkd->mqk", vectors, books, optimize=True)
                width = min(p.shortlist, len(ids))
                top_ids, top_scores = [], []
                for low in range(0, len(queries), 32):
                    score = np.zeros((len(vectors[low : low + 32]), len(ids)), np.float32)
                    for m in range(len(codes)):
                        score += table[m, low : low + 32][:, codes[m]]
                    score /= norms
                    best = np.argpartition(-score, width - 1, axis=1)[:, :width]
                    edge = np.take_along_axis(score, best, axis=1).min(axis=1)
                    for s, e in zip(score, edge, strict=True):  # of equal scores at the edge the smaller ids
                        above, level = np.flatnonzero(s > e), np.flatnonzero(s == e)
                        chosen = np.concatenate([above, level[: width - len(above)]])
                        top_ids.append(ids[chosen])
                        top_scores.append(s[chosen])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(queries, [len(x) for x in top_ids])), pa.array(np.concatenate(top_ids)), pa.array(np.concatenate(top_scores))], ["query_id", "class_id", "guess"]
                )

    return run


def nearest(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """query_id, rank, vec_id and score: the p.near nearest found of every query, a row whose vec_id is divisible by p.every."""
    rows = cut(usable(vectors))
    lengths = [r.n for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    parts = [_nearest(rows if len(lengths) == 1 else rows.where(F.size("v") == n), p) for n in lengths]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], SCHEMA)


def _nearest(rows: DataFrame, p: Params) -> DataFrame:
    """The same among vectors of one length."""
    alike = Window.partitionBy("v").orderBy("vec_id")
    copies = rows.withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= p.near + 1)
    classes = cut(copies.groupBy("v").agg(F.min("vec_id").alias("class_id"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    picked = classes.orderBy(F.xxhash64("class_id"), "class_id").limit(p.sample).select("v").toArrow()
    books = train(_matrix(picked.column("v").combine_chunks()), p)
    shares = max(1, -(-classes.count() // p.code_block))
    coded = classes.select(F.col("class_id").alias("vec_id"), "v").mapInArrow(freed(_coder(books, p)), "vec_id long, code binary, norm float")
    coded = coded.withColumn("share", F.pmod(F.xxhash64("vec_id"), F.lit(shares)))
    codes = coded.groupBy("share").applyInArrow(_pack_codes, "share long, ids binary, codes binary, norms binary")
    queries = rows.where(F.col("vec_id") % p.every == 0)
    n_blocks = max(1, -(-queries.count() // p.query_block))
    packed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))).groupBy("block").applyInArrow(_pack, "block long, queries binary, vectors binary")
    # packed blocks meet by number and share: a block of codes is sent once to each block of queries, whose copies wait in every share
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    tasks, keys = min(n_blocks * shares, p.tasks), ["block", "share"]
    dealt = codes.withColumn("block", every(n_blocks)).repartition(tasks, *keys)
    asking = packed.withColumn("share", every(shares)).repartition(tasks, *keys)
    found = dealt.join(asking.hint("merge"), keys).mapInArrow(freed(_scanner(books, p)), "query_id long, class_id long, guess float")
    best = Window.partitionBy("query_id").orderBy(F.desc("guess"), "class_id")
    short = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= p.shortlist).select("query_id", "class_id")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("q", "v") / (F.sqrt(dot("q", "q")) * F.sqrt(dot("v", "v")))
    scored = short.join(classes.hint("merge"), "class_id").join(asked.hint("merge"), "query_id").select("query_id", cosine.alias("score"), F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.near)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
