"""Toxicity: a support vector machine over sentences with a gapped subsequence kernel and Nyström landmarks.

The kernel of two words is the sum over subsequences of three bytes that span at most `span` + 1 bytes in each, every
inserted byte costing a factor `decay`, and over runs of four and five bytes, over both words' norms; so "id*iot" and
"i.d.i.o.t" stay close to "idiot". The kernel of two sentences is the sum over their pairs of words, over the roots of
their numbers of words; in training each subsequence counts by its rarity in the training sentences. Words are runs of
bytes that aren't white space; three or more one-byte words in a row are read as one ("i d i o t"), and words of over
`long_word` bytes as pieces of that size. A sentence ends after a word that ends in `.`, `!` or `?`, at a line's end, or
after `width` words.

Labels are of texts, so the sentences that bear a toxic one's label are found in rounds: the first takes every
training sentence under its text's label (the difference of the classes' means, each subsequence over its spread, a
word once a text), each later one takes the sentences of every training text that the last machine scores highest, as
toxic or clean as their text, and trains a squared-hinge machine on their Nyström features. From the second on, a toxic
text teaches only if its highest sentence lies above those of most clean texts (`apart`), since labels hold errors. A
text's score is a logistic curve over its highest sentence's decision value alone, fitted on training texts that the
machine hasn't seen.

A decision value is linear in the kernel and the kernel's features are short, so the landmark expansion is folded into
one weight per hashed subsequence; scoring is a table look-up.

Training rows are a bounded sample (Params.docs of each class, by hashed id) of the labelled rows whose crc32(doc_id)
mod 3 is not 1; every document is scored on its whole text. Null and empty texts, and those without a word of three
bytes, get the score of the lowest decision value (`floor`). With no toxic or no clean training row the score is 0.
Repeated rows get equal results, one for each row. An empty table gives no rows. Very long texts are scored whole. Only
doc_id and text (and of labels doc_id and toxic) are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._memory import freed


@dataclass(frozen=True)
class Params:
    #: Training texts of each class at most; one in `aside` of them only calibrates.
    docs: int = 4_000
    aside: int = 8
    #: With fewer of a class set aside, all training texts calibrate.
    enough: int = 10
    #: Rounds of training, the sentences of a clean text that one adds, and those of a toxic text that teach in the later ones.
    rounds: int = 3
    hardest: int = 3
    bearing: int = 3
    apart: float = 0.8
    #: Landmark sentences of each class.
    landmarks: int = 400
    width: int = 8
    long_word: int = 64
    span: int = 4
    decay: float = 0.6
    #: Lengths of the longer runs without a gap that count, too.
    runs: tuple[int, ...] = (4, 5)
    bits: int = 18
    cost: float = 10.0
    #: Share of the mean square that a subsequence's own is raised by before its rarity is taken.
    smooth: float = 0.03
    #: Errors by which a subsequence's mean must differ between the classes to count in the first round.
    deviations: float = 2.0
    #: Decision value of a text without a scorable word.
    floor: float = -3.0
    threshold: float = 0.7


def _tables() -> np.ndarray:
    return (B.mix(np.arange(1280, dtype=np.uint64) + np.uint64(77)) >> np.uint64(32)).astype(np.uint32).reshape(5, 256)


def _gaps(p: Params) -> list[tuple[tuple[int, ...], float]]:
    """(offsets of the bytes after the first, weight) of every allowed subsequence."""
    return [((a, b), p.decay ** (b - 2)) for b in range(2, p.span + 1) for a in range(1, b)] + [(tuple(range(1, n)), 1.0) for n in p.runs]


def _norms(length: np.ndarray, p: Params) -> np.ndarray:
    """Root of a word's summed squared feature weights, by its length."""
    total = sum(np.maximum(length - later[-1], 0) * w * w for later, w in _gaps(p))
    return np.sqrt(np.maximum(total, 1e-12))


def sentences(buf: np.ndarray, offsets: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of three bytes or more, its sentence's number, and every sentence's text number."""
    start, end, text = B.words(buf, offsets)
    line = np.cumsum(buf == 10)
    stops = np.isin(buf[end - 1], np.frombuffer(b".!?", np.uint8))
    single = (end - start == 1) & ~stops
    together = np.zeros(len(start), bool)  # this word and the one before are letters of a run
    together[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1]) & (line[start[1:]] == line[start[:-1]])
    first = np.flatnonzero(~together)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    start, end, text, stops = start[first], end[last], text[first], stops[last]
    pieces = np.maximum(-(-(end - start) // p.long_word), 1)
    if len(start) and pieces.max() > 1:
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = np.repeat(end, pieces)
        start = np.repeat(start, pieces) + nth * p.long_word
        end, text = np.minimum(start + p.long_word, whole), np.repeat(text, pieces)
        stops = np.repeat(stops, pieces) & (end == whole)
    new = np.ones(len(start), bool)
    new[1:] = stops[:-1] | (text[1:] != text[:-1]) | (line[start[1:]] != line[end[:-1] - 1])
    began = np.maximum.accumulate(np.where(new, np.arange(len(start)), 0))
    new |= (np.arange(len(start)) - began) % p.width == 0
    number = np.cumsum(new) - 1
    scorable = end - start >= 3
    start, end, number, text = start[scorable], end[scorable], number[scorable], text[scorable]
    _, where, number = np.unique(number, return_index=True, return_inverse=True)
    return start, end, number, text[where]


def _subsequences(buf: np.ndarray, start: np.ndarray, end: np.ndarray, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray, np.float32]]:
    """For every allowed gap: hashed subsequence at each byte, whether it stays inside its word, and its weight."""
    n, tables = len(buf), [t[buf] for t in _tables()]
    left = np.zeros(n, np.int32)
    sizes = end - start
    at = np.repeat(end, sizes) - 1
    inside = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(at))
    left[inside] = at - inside  # bytes of the word after this one
    for later, w in _gaps(p):
        m = n - later[-1]
        if m > 0:
            yield sum((t[a : m + a] for t, a in zip(tables[1:], later)), tables[0][:m]) >> np.uint32(32 - p.bits), left[:m] >= later[-1], np.float32(w)


def _scales(start: np.ndarray, end: np.ndarray, number: np.ndarray, p: Params) -> np.ndarray:
    """What a word's features are multiplied with in its sentence."""
    return 1 / (_norms(end - start, p) * np.sqrt(np.bincount(number))[number]) if len(start) else np.zeros(0)


def decisions(buf: np.ndarray, start: np.ndarray, end: np.ndarray, number: np.ndarray, beta: np.ndarray, bias: float, p: Params) -> np.ndarray:
    """The decision value of every sentence."""
    value = np.zeros(len(buf), np.float32)
    for index, fits, w in _subsequences(buf, start, end, p):
        value[: len(index)] += np.where(fits, w * beta[index], np.float32(0))
    total = np.add.reduceat(value.astype(float), np.column_stack([start, end]).ravel().clip(max=len(value) - 1))[::2] if len(start) else np.zeros(0)
    return np.bincount(number, total * _scales(start, end, number, p)) + bias


def _highest(beta: np.ndarray, bias: float, p: Params, keep: int):
    """Of every text its highest decision value and, on demand, the `keep` sentences with the highest ones."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, bytes_of = [np.zeros(0)], []
            for low, high, raw, offsets in B.slices(batch.column("text")):
                buf = B.LOWER[raw]
                start, end, number, text = sentences(buf, offsets, p)
                value = decisions(buf, start, end, number, beta, bias, p)
                out = np.full(high - low, -np.inf)
                np.maximum.at(out, text, value)
                found.append(np.where(np.isfinite(out), out, p.floor))
                if keep:
                    order = np.lexsort((np.arange(len(text)), -value, text))
                    place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
                    edge = np.searchsorted(number, np.arange(len(text) + 1))
                    held: list[list[bytes]] = [[] for _ in range(high - low)]
                    for k in order[place < keep]:
                        held[text[k]].append(b" ".join(bytes(buf[a:b]) for a, b in zip(start[edge[k] : edge[k + 1]], end[edge[k] : edge[k + 1]], strict=True)))
                    bytes_of += held
            rest = [c for c in batch.schema.names if c != "text"]
            extra = [pa.array(np.concatenate(found))] + ([pa.array(bytes_of, pa.list_(pa.binary()))] if keep else [])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + extra, rest + ["value", "said"][: len(extra)])

    return score


def _means(p: Params):
    """Of a partition's sentences, by class: how many, and sum and sum of squares of every subsequence's feature."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << p.bits
        sums, squares, counts = np.zeros((2, size)), np.zeros((2, size)), np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column("toxic").to_numpy(zero_copy_only=False)
            for low, high, raw, offsets in B.slices(batch.column("text")):
                buf = B.LOWER[raw]
                start, end, number, text = sentences(buf, offsets, p)
                scale, kind = np.zeros(len(buf)), np.zeros(len(buf), np.int8)
                counts += np.bincount(label[low:high][text], minlength=2)
                pairs = B.pair(B.fingerprint(B.prefix(buf), start, end), text[number].astype(np.uint64))
                once = np.sort(np.unique(pairs, return_index=True)[1])
                start, end, number = start[once], end[once], number[once]
                word = np.repeat(np.arange(len(start)), end - start)
                at = np.repeat(start - (np.cumsum(end - start) - (end - start)), end - start) + np.arange(len(word))
                scale[at] = _scales(start, end, number, p)[word]
                kind[at] = label[low:high][text[number]][word]
                for index, fits, w in _subsequences(buf, start, end, p):
                    for k in (0, 1):
                        mine = fits & (kind[: len(fits)] == k)
                        x = scale[: len(fits)][mine] * w
                        sums[k] += np.bincount(index[mine], x, size)
                        squares[k] += np.bincount(index[mine], x * x, size)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(counts), *[pa.array([x.astype(np.float32).tobytes() for x in m]) for m in (sums, squares)]], ["toxic", "n", "total", "square"])

    return add


def _start(parts: list, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Of every subsequence the difference of the classes' means over its error, less what chance gives, and its rarity."""
    n, total, square = np.zeros((2, 1)), np.zeros((2, 1 << p.bits)), np.zeros((2, 1 << p.bits))
    for r in parts:
        n[r["toxic"]] += r["n"]
        total[r["toxic"]] += np.frombuffer(r["total"], np.float32)
        square[r["toxic"]] += np.frombuffer(r["square"], np.float32)
    n = np.maximum(n, 1)
    mean = total / n
    spread = np.sqrt(np.maximum((square / n - mean * mean) / n, 0).sum(axis=0))
    far = (mean[1] - mean[0]) / (spread + 0.1 / n.min())
    usual = square.sum(axis=0) / n.sum()
    rarity = 1 / np.sqrt(usual + p.smooth * usual.mean())
    return (np.sign(far) * np.maximum(abs(far) - p.deviations, 0)).astype(np.float32), (rarity / np.sqrt((rarity**2 * usual).sum() / usual.sum())).astype(np.float32)


def _features(said: list[bytes], rarity: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, hashed subsequence, weight) of every feature of sentences without words under three bytes."""
    buf = np.frombuffer(b"\n".join(said), np.uint8)
    sizes = np.array([len(s) + 1 for s in said])
    edge = np.concatenate([[0], np.cumsum(sizes)])
    start, end, _ = B.words(buf, np.array([0, len(buf)]))
    number = np.searchsorted(edge, start, "right") - 1
    scale = np.zeros(len(buf), np.float32)
    word = np.repeat(np.arange(len(start)), end - start)
    at = np.repeat(start - (np.cumsum(end - start) - (end - start)), end - start) + np.arange(len(word))
    scale[at] = (1 / (_norms(end - start, p) * np.sqrt(np.bincount(number, minlength=len(said)))[number]))[word]
    found = []
    for index, fits, w in _subsequences(buf, start, end, p):
        hit = np.flatnonzero(fits)
        found.append((hit, index[hit], scale[hit] * w))
    hit, index, weight = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(hit, kind="stable")
    return np.searchsorted(edge, hit[order], "right") - 1, index[order].astype(np.int64), weight[order] * rarity[index[order]]


def _spread(said: list[bytes], n: int) -> list[bytes]:
    """n of them, by hash."""
    order = B.mix(np.arange(1, len(said) + 1, dtype=np.uint64) * np.uint64(B.BASE)).argsort()
    return [said[k] for k in order[:n]]


def train(positive: list[bytes], negative: list[bytes], rarity: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """(weight of each hashed subsequence, bias): a squared-hinge machine on Nyström features, by Newton steps."""
    marks = _spread(positive, p.landmarks) + _spread(negative, p.landmarks)
    by, index, weight = _features(marks, rarity, p)
    used = np.unique(index)  # no other subsequence adds to a kernel value
    place = np.full(1 << p.bits, -1, np.int32)
    place[used] = np.arange(len(used))
    by_at = place[index]

    def kernel(said: list[bytes]) -> np.ndarray:
        parts = [_features(said[c : c + 512], rarity, p) for c in range(0, len(said), 512)]
        number = np.concatenate([(n + 512 * c).astype(np.int32) for c, (n, _, _) in enumerate(parts)])
        at = np.concatenate([place[i] for _, i, _ in parts])
        scale = np.concatenate([w.astype(np.float32) for _, _, w in parts])
        del parts
        number, at, scale = (x[at >= 0] for x in (number, at, scale))
        first = np.flatnonzero(np.diff(number, prepend=-1))
        cuts = np.append(first[:: 256], len(number))  # features of 256 sentences at a time
        out = np.zeros((len(said), len(marks)), np.float32)
        for m in range(0, len(marks), 64):
            mine = (by >= m) & (by < m + 64)
            phi = np.zeros((len(used), min(64, len(marks) - m)), np.float32)
            np.add.at(phi, (by_at[mine], by[mine] - m), weight[mine])
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                here = first[np.searchsorted(first, low) : np.searchsorted(first, high)]
                out[number[here], m : m + phi.shape[1]] = np.add.reduceat(phi[at[low:high]] * scale[low:high, None], here - low)
        return out

    values, vectors = np.linalg.eigh(kernel(marks) + 1e-3 * np.eye(len(marks)))
    root = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    x = np.empty((len(positive) + len(negative), len(marks) + 1), np.float32)
    x[:, :-1], x[:, -1] = kernel(positive + negative) @ root.astype(np.float32), 1
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    share = np.repeat([p.cost / len(positive), p.cost / len(negative)], [len(positive), len(negative)]) * 100
    w = np.zeros(x.shape[1])
    for turn in range(30):
        left, right = np.eye(len(w)), np.zeros(len(w))
        left[-1, -1] = 1e-3
        for c in range(0, len(x), 2048):
            xa, ya, sa = x[c : c + 2048].astype(float), y[c : c + 2048], share[c : c + 2048]
            sa = np.where(ya * (xa @ w) < 1, sa, 0.0)
            xs = (xa * sa[:, None]).T
            left += xs @ xa
            right += xs @ ya
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-8):
            break
        w = 0.5 * (w + new) if turn > 10 else new
    beta = np.zeros(1 << p.bits, np.float32)
    np.add.at(beta, index, weight * (root @ w[:-1])[by] * rarity[index])
    return beta, float(w[-1])


def calibrate(value: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over decision values; both classes weigh the same."""
    mean, spread = value.mean(), value.std() + 1e-6
    share = np.where(label == 1, 0.5 / max((label == 1).sum(), 1), 0.5 / max((label == 0).sum(), 1))
    x, t = np.column_stack([(value - mean) / spread, np.ones(len(value))]), np.where(label == 1, 0.99, 0.01)
    w, ridge = np.zeros(2), 1e-3 * np.eye(2)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * q * (1 - q) + 1e-9)[:, None]).T @ x + ridge, x.T @ (share * (q - t)) + ridge @ w)
        w -= step
        if abs(step).max() < 1e-9:
            break
    w[0] = max(w[0], 0.0)  # a higher decision value never means less toxic
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> tuple[np.ndarray, float, float, float] | None:
    """(weights, bias, slope, intercept), or None where a class has no training sentence."""
    spark = documents.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = [known.where(F.col("toxic") == k).limit(p.docs).collect() for k in (1, 0)]
    picked = [(r.doc_id, r.toxic, n % p.aside == 0) for rows in sample for n, r in enumerate(rows)]
    if len({t for _, t, _ in picked}) < 2:
        return None
    ids = F.broadcast(spark.createDataFrame(picked, "doc_id long, toxic int, aside boolean"))
    texts = documents.select("doc_id", "text").join(ids, "doc_id").repartition(8, "doc_id").coalesce(8).persist()
    try:
        seen = texts.where("not aside").select("toxic", "text")
        parts = seen.mapInArrow(freed(_means(p)), "toxic int, n long, total binary, square binary").collect()
        if len({r["toxic"] for r in parts if r["n"]}) < 2:
            return None
        (beta, rarity), bias, negative = _start(parts, p), 0.0, {}
        for turn in range(p.rounds):
            best = seen.mapInArrow(freed(_highest(beta, bias, p, max(p.hardest, p.bearing))), "toxic int, value double, said array<binary>").collect()
            clean = [r for r in best if not r.toxic and r.said]
            least = np.quantile([r.value for r in clean], p.apart) if turn else -np.inf
            told = [r for r in best if r.toxic and r.said and r.value > least] or [r for r in best if r.toxic and r.said]
            positive = sorted(bytes(s) for r in told for s in r.said[: p.bearing if turn else 1])
            negative |= dict.fromkeys(sorted(bytes(s) for r in clean for s in r.said[: p.hardest]))
            beta, bias = train(positive, list(negative), rarity, p)
        last = texts.select("toxic", "aside", "text").mapInArrow(freed(_highest(beta, bias, p, 0)), "toxic int, aside boolean, value double").toPandas()
        fresh = last[last.aside]
        judged = fresh if fresh.toxic.value_counts().reindex([0, 1]).min() >= p.enough else last
        return beta, bias, *calibrate(judged.value.to_numpy(), judged.toxic.to_numpy())
    finally:
        texts.unpersist()


def toxicity(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(documents, labels, p)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        scored = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:
        beta, bias, slope, intercept = model
        valued = rows.mapInArrow(freed(_highest(beta, bias, p, 0)), "doc_id long, value double")
        logit = slope * F.col("value") + intercept
        scored = valued.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))
