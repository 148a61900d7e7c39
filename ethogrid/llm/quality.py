"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two multinomials over hashed word unigrams and bigrams are estimated: one from documents that
labellers trust (all of them), one from every document of the corpus. A document's score is
the mean over its n-grams of log p_target - log p_raw, so long and short texts compare. Every
document is judged by the same threshold, which is a quantile of the trusted documents' own
scores (each half of them scored by the other half's model); nothing is drawn at random.

Nulls and empty texts have no n-grams: their score is 0 and the method keeps them (the base
rules fail them for having too few words). Repeated rows get equal results, one for each row.
Without any trusted document no ratio exists: all scores are 0 and only the base rules decide. An empty table
gives no rows. Very long texts are counted whole. Only doc_id, text (and of labels doc_id and quality) and what is
to be carried are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid.session import cut

from . import _bytes as B
from ._memory import freed

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 16
    #: Strength of the raw corpus as the prior of the target's counts, as a share of these.
    prior: float = 0.5
    #: The threshold lies below the trusted documents' scores, but for this share of them ...
    tail: float = 0.02
    #: ... and by this much more, so that clean documents that nobody labelled stay.
    margin: float = 0.1
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Bytes of the trusted documents' ids up to which they are sent to every task; beyond, texts are joined to them.
    small: int = 8 << 20


def _grams(buf: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every unigram and bigram."""
    start, end, text = B.words(buf, offsets)
    one = B.fingerprint(B.prefix(B.LOWER[buf]), start, end)
    same = text[1:] == text[:-1]
    two = B.pair(one[:-1], one[1:])[same]
    return np.concatenate([text, text[1:][same]]), (np.concatenate([one, two]) % np.uint64(buckets)).astype(np.int64)


def _counter(p: Params, halves: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, p.buckets), np.int64)
        for batch in batches:
            half = batch.column("half").to_numpy(zero_copy_only=False) if halves else np.zeros(batch.num_rows, np.int64)
            for low, _, buf, offsets in B.slices(batch.column("text")):
                text, bucket = _grams(buf, offsets, p.buckets)
                total += np.bincount(half[low + text] * p.buckets + bucket, minlength=2 * p.buckets).reshape(2, -1)
        half, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(half), pa.array(bucket), pa.array(total[half, bucket])], ["half", "bucket", "n"])

    return count


def _counts(texts: DataFrame, p: Params, halves: bool = False) -> np.ndarray:
    """Counts of all n-grams by half (the first, if there are none) and bucket; each task sends at most one row for each."""
    rows = texts.select("text", *["half"] * halves).mapInArrow(freed(_counter(p, halves)), "half long, bucket long, n long").groupBy("half", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((2, p.buckets))
    out[rows["half"].to_numpy(np.int64), rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return out


def _scorer(ratio: np.ndarray, p: Params, wanted: str, with_text: bool = False):
    def base(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        n = len(offsets) - 1
        start, end, text = B.words(buf, offsets)
        sums = B.prefix(buf)
        count = lambda where, weights=None: np.bincount(where, weights, minlength=n).astype(np.int64)
        lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        word = B.fingerprint(sums, start, end)
        # words in three-word windows that are found twice or more in the text
        three = B.pair(B.pair(word[:-2], word[1:-1]), word[2:]) if len(word) > 2 else word[:0]
        at = np.flatnonzero(text[2:] == text[:-2]) if len(word) > 2 else np.zeros(0, np.int64)
        order = at[np.lexsort((three[at], text[at]))]
        twin = (three[order][1:] == three[order][:-1]) & (text[order][1:] == text[order][:-1])
        again = np.zeros(len(order), bool)
        again[1:] |= twin
        again[:-1] |= twin
        covered = np.zeros(len(word), bool)
        for k in range(3):
            covered[order[again] + k] = True
        # lines with a word, equal to an earlier line
        breaks = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(buf == 10) + 1]))
        breaks = breaks[breaks < len(buf)]
        stop = np.append(breaks[1:], len(buf))[: len(breaks)]
        stop = stop - (buf[stop - 1] == 10)
        line = np.searchsorted(offsets, breaks, "right") - 1
        has = np.searchsorted(start, stop) > np.searchsorted(start, breaks)
        lines, first = line[has], B.fingerprint(sums, breaks[has], stop[has])
        once, _ = B.distinct(lines, first)
        return {
            "n_words": count(text),
            "word_chars": count(text, lead[end] - lead[start]),
            "n_symbols": np.diff(np.concatenate([[0], np.cumsum(IS_SYMBOL[buf])])[offsets]),
            "n_dup_lines": count(lines) - count(once),
            "n_repeat_words": count(text[covered]),
        }

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for low, high, buf, offsets in B.slices(batch.column("text")):
                n = high - low
                text, bucket = _grams(buf, offsets, p.buckets)
                size = np.bincount(text, minlength=n)
                parts.append({"score": np.bincount(text, ratio[bucket], minlength=n) / np.maximum(size, 1)} | (base(buf, offsets) if wanted == "all" else {}))
            if parts:
                keep = [c for c in batch.schema.names if c != "text" or with_text]
                columns = {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(v) for v in columns.values()], keep + list(columns))

    return score


def _crossed(ratios: list[np.ndarray], p: Params):
    """doc_id and score of each text, by the ratio of the half it isn't in."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column("half").to_numpy(zero_copy_only=False)
            for low, high, buf, offsets in B.slices(batch.column("text")):
                text, bucket = _grams(buf, offsets, p.buckets)
                value = np.where(half[low + text] == 0, ratios[1][bucket], ratios[0][bucket])
                size = np.bincount(text, minlength=high - low)
                found = np.bincount(text, value, minlength=high - low) / np.maximum(size, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(found)], ["doc_id", "score"])

    return score


def fit(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> tuple[np.ndarray, float]:
    """(log ratio of each bucket, threshold). Raw counts cover all documents; target and threshold all trusted ones."""
    nothing = np.zeros(p.buckets), -np.inf
    raw = _counts(documents, p)[0]
    if not raw.sum():
        return nothing
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    trusted = cut(trusted)
    side = F.broadcast(trusted) if trusted.count() * 16 <= p.small else trusted.hint("merge")
    targets = _counts(rows.join(side, "doc_id"), p, halves=True)
    if not targets.sum():
        return nothing
    p_raw = (raw + 1) / (raw.sum() + p.buckets)

    def ratio(target: np.ndarray) -> np.ndarray:
        strength = p.prior * max(target.sum(), 1)
        return np.log((target + strength * p_raw) / (target.sum() + strength)) - np.log(p_raw)

    # each half is scored by the other, as documents that nobody labelled will be; texts are scored where they lie and
    # only scores are dealt out; a rank is off by a millionth of the rows at most
    own = rows.mapInArrow(freed(_crossed([ratio(t) for t in targets], p)), "doc_id long, score double").join(side, "doc_id")
    low = own.agg(F.percentile_approx("score", p.tail, 1_000_000).alias("low")).first().low
    return ratio(targets.sum(axis=0)), float(low) - p.margin


def quality_rules(documents: DataFrame, labels: DataFrame, p: Params = Params(), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score and carried columns of every row."""
    ratio, threshold = fit(documents, labels, p)
    kinds = dict(documents.dtypes)
    others = [c for c in carry if c != "text"]
    schema = "doc_id long, " + "text string, " * ("text" in carry) + "".join(f"`{c}` {kinds[c]}, " for c in others)
    schema += "score double, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *others).mapInArrow(freed(_scorer(ratio, p, "all", "text" in carry)), schema)
    failed = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("score") >= F.lit(threshold))).alias("kept"), "score", *carry,
    )
