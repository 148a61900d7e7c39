"""BPE encoding and decoding by a table of distinct words.

Texts are split into words in Spark's tasks, some 32 MB of text at a time (a chunk), and become codes
into the chunk's own list of words. Those lists are dealt into buckets by word: a bucket holds every
occurrence of its words in any chunk's list, so each distinct word of the corpus is encoded once. The
ids go back to the chunks, where they take the words' places, position by position. A word is in one
row of a chunk at most, so a frequent one is a row a chunk, never a row an occurrence. Decoding joins
ids with the vocabulary's pieces, whose number the tokenizer's file bounds.

The tokenizer's file says what is done: canonical composition, lower case, words by pattern, bytes as
symbols, merges by rank with a mark at a word's end, special tokens where their strings stand in a
text. Files of another make are refused. Characters that Python's tables and the library's may see
differently are left to the library's own normaliser and splitter, text by text.

Null texts count as empty ones: no ids, and '' decoded. Repeated rows and rows without a doc_id give a row each. Texts may
have any length; one text is never divided, so a task needs some ten times its longest text. An empty table gives no
rows. Only doc_id and text (or ids) are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethogrid.session import cut

from ._memory import freed, release

#: The words of the tokenizer's pattern: what an apostrophe may begin, letters, one number, other characters. Fixed values.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
BLANK, LETTER, NUMBER, OTHER = range(4)
#: Code points below it are looked up in tables.
KNOWN = 0x20000
ROW = "chunk long, part int, docs array<long>, n long, data binary"


@dataclass(frozen=True)
class Params:
    """Bytes of text, and words, of a chunk; bytes of text of a row of codes; words of a bucket."""

    chunk: int = 1 << 25
    words: int = 400_000
    part: int = 1 << 21
    bucket: int = 400_000


def read_tokenizer(path: str | None = None) -> bytes:
    """The tokenizer file's bytes, read by the driver; they travel with the tasks (some 2 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()


class Splitter:
    """The words of texts, as the tokenizer's normaliser and pattern make them."""

    def __init__(self, raw: bytes):
        from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

        spec = json.loads(raw)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": PATTERN}:
            raise ValueError("a tokenizer of another make")
        special = [re.escape(x["content"]) for x in sorted(spec["added_tokens"], key=lambda x: -len(x["content"]))]
        self.special = re.compile(f"({'|'.join(special)})") if special else None
        self.normalise = Tokenizer.from_str(raw.decode()).normalizer.normalize_str
        self.split = pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True).pre_tokenize_str
        points = [chr(c) for c in range(KNOWN) if not 0xD800 <= c < 0xE000]
        at = np.array([ord(c) for c in points])
        # one line a character, twice between letters: the number of its words tells the class
        lines = np.cumsum([0] + [5] * len(points))
        starts = [low for _, (low, _) in self.split("\n".join(f"a{c}{c}b" for c in points))]
        words = np.bincount(np.searchsorted(lines, starts, "right") - 1, minlength=len(points))
        self.kind = np.full(KNOWN, OTHER, np.uint8)
        self.kind[at] = np.array([OTHER, LETTER, BLANK, OTHER, NUMBER], np.uint8)[words]
        lower = normalizers.Lowercase().normalize_str("\n".join(points)).split("\n") if len(points) else []
        lower = [low or c for low, c in zip(lower[:10] + [""] + lower[12:], points, strict=True)]  # the line end is a line of two
        self.lower = np.arange(KNOWN, dtype=np.uint32)
        odd = np.array([len(x) != 1 or (ord(x) >= KNOWN) or unicodedata.category(c) == "Cn" for x, c in zip(lower, points, strict=True)])
        self.lower[at] = [ord(c) if o else ord(x) for x, c, o in zip(lower, points, odd, strict=True)]
        self.odd = np.ones(KNOWN, bool)
        self.odd[at] = odd

    def slowly(self, text: str) -> list[str]:
        return [w for w, _ in self.split(self.normalise(text))]

    def words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All words of the texts, and how many each text has. A special token is a word with a blank before it."""
        lists: dict[int, list[str]] = {}
        plain = []
        for k, t in enumerate(texts):
            if self.special and self.special.search(t):
                parts = self.special.split(t)
                lists[k] = [w for i, p in enumerate(parts) for w in ([f" {p}"] if i % 2 else self.slowly(p))]
                t = ""
            plain.append(t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))
        sizes = np.array([len(t) for t in plain])
        points = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), sizes)
        far = points >= KNOWN
        low = np.where(far, 0, points)
        for k in np.unique(owner[far | self.odd[low]]).tolist():
            lists[k] = self.slowly(texts[k])
        if lists:
            keep = ~np.isin(owner, list(lists))
            low, owner = low[keep], owner[keep]
        low = self.lower[low]
        kind = self.kind[low]
        first = np.ones(len(low), bool)  # where a run of one class begins
        first[1:] = (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
        start = first | (kind == NUMBER)
        # an apostrophe alone takes the letters of an ending with it, and what follows is a word of its own
        last = np.append(first[1:], True)
        lone = np.flatnonzero((low == ord("'")) & first & last)
        padded = np.concatenate([low, np.zeros(3, np.uint32)])
        whose = np.concatenate([owner, np.full(3, -1)])
        taken = np.zeros(len(lone), np.int64)
        for end in ENDINGS:
            fits = np.ones(len(lone), bool)
            for j, c in enumerate(end, 1):
                fits &= (padded[lone + j] == ord(c)) & (whose[lone + j] == owner[lone])
            taken = np.where(fits & (taken == 0), len(end), taken)
        lone, taken = lone[taken > 0], taken[taken > 0]
        start[lone + 1] = False
        after = lone + 1 + taken
        after = after[after < len(low)]
        start[after] |= kind[after] != BLANK
        kept = kind != BLANK
        start &= kept
        low, start, owner = low[kept], np.flatnonzero(start[kept]), owner[kept]
        data = low.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        size = 1 + (low >= 0x80) + (low >= 0x800) + (low >= 0x10000)
        offsets = np.concatenate([[0], np.cumsum(size)])[np.append(start, len(low))].astype(np.int64)
        found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data))
        counts = np.bincount(owner[start], minlength=len(texts))
        if not lists:
            return found, counts
        ends, pieces = np.cumsum(counts), []
        for k in range(len(texts)):
            if k in lists:
                pieces.append(pa.array(lists[k], pa.large_string()))
                counts[k] = len(lists[k])
            else:
                pieces.append(found.slice(ends[k] - counts[k], counts[k]))
        return pa.concat_arrays(pieces), counts


class Merger:
    """Ids of words, merge by merge; and the piece of each id."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or model["dropout"] or model["byte_fallback"] or spec["decoder"]:
            raise ValueError("a tokenizer of another make")
        vocabulary = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: Rank and new id of each pair of ids.
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        # a byte is written as its own character where that prints, else as one of those from 256 on
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        symbols = {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in prints)}
        self.inner, self.last = ([vocabulary[symbols[b] + mark] for b in range(256)] for mark in ("", "</w>"))
        self.pieces = {i: p for p, i in (vocabulary | self.special).items()}

    def encode(self, word: str) -> list[int]:
        """The lowest rank merges first, of equal ones the leftmost."""
        if word.startswith(" "):
            return [self.special[word[1:]]]
        data = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        return self._short(ids) if len(ids) <= 24 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        merges, none = self.merges, (1 << 60, -1)
        while len(ids) > 1:
            best = [merges.get(p, none) for p in zip(ids, ids[1:])]  # noqa: B905
            rank, new = least = min(best)
            if rank == none[0]:
                break
            at = best.index(least)
            ids[at : at + 2] = [new]
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap of the pairs that may merge."""
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0 and (hit := self.merges.get((ids[k], ids[after[k]]))):
                heapq.heappush(heap, (hit[0], k, hit[1]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, new = heapq.heappop(heap)
            right = after[k]
            if ids[k] < 0 or right < 0 or self.merges.get((ids[k], ids[right]), (0, -1))[1] != new:
                continue  # one of the two has merged since
            ids[k], ids[right], after[k] = new, -1, after[right]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [i for i in ids if i >= 0]


@lru_cache(1)
def splitter(raw: bytes) -> Splitter:
    return Splitter(raw)


@lru_cache(1)
def merger(raw: bytes) -> Merger:
    return Merger(raw)


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def _restored(data: bytes | memoryview) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers: small ones take a byte, the others' bytes go apart, as the high ones are mostly equal."""
    x = np.concatenate([np.asarray(a).astype(np.uint32) for a in arrays])
    small = x < 255
    rest = np.ascontiguousarray(x[~small])
    head = np.array([len(arrays), *map(len, arrays)], np.uint32).tobytes()
    return head + _squeezed(np.where(small, x, 255).astype(np.uint8).tobytes() + rest.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    sizes = np.frombuffer(data, np.uint32, n, 4).astype(np.int64)
    flat = np.frombuffer(_restored(memoryview(data)[4 + 4 * n :]), np.uint8)
    x = flat[: sizes.sum()].astype(np.uint32)
    x[x == 255] = np.ascontiguousarray(flat[sizes.sum() :].reshape(4, -1).T).view(np.uint32).ravel()
    return np.split(x, np.cumsum(sizes)[:-1])


def _row(chunk: int, part: int, docs: list, n: int, data: bytes) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((chunk, part, docs, n, data), kinds, strict=True)], ["chunk", "part", "docs", "n", "data"])


def _coded(raw: bytes, p: Params):
    """Texts as rows of codes (part 0, 1 ...) and, for each chunk, its list of words (part -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split = splitter(raw)
        base, chunk, held, part, known = TaskContext.get().partitionId() << 32, 0, 0, 0, {}
        for batch in batches:
            docs, column = batch.column("doc_id").to_pylist(), batch.column("text")
            size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            low = 0
            while low < len(docs):
                high = max(low + 1, int(np.searchsorted(np.cumsum(size[low:]), p.part, "right")) + low)
                found, counts = split.words([t or "" for t in column.slice(low, high - low).to_pylist()])
                coded = found.dictionary_encode()
                own = coded.dictionary.to_pylist()
                codes = np.array([known.setdefault(w, len(known)) for w in own], np.uint32)[coded.indices.to_numpy()] if own else np.zeros(0, np.uint32)
                yield _row(base | chunk, part, docs[low:high], len(codes), _packed(counts, codes))
                held, part, low = held + int(size[low:high].sum()), part + 1, high
                if held >= p.chunk or len(known) >= p.words:
                    yield _row(base | chunk, -1, [], len(known), _squeezed("\n".join(known).encode("utf-8", "surrogatepass")))
                    chunk, held, part, known = chunk + 1, 0, 0, {}
        if part:
            yield _row(base | chunk, -1, [], len(known), _squeezed("\n".join(known).encode("utf-8", "surrogatepass")))

    return run


def _dealt(buckets: int):
    """A chunk's list of words, dealt into buckets by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, n, data in zip(batch.column("chunk").to_pylist(), batch.column("n").to_pylist(), batch.column("data").to_pylist(), strict=True):
                words = _restored(data).split(b"\n") if n else []
                bucket = np.array([zlib.crc32(w) for w in words], np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                bounds = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
                rows = [(b, order[i:j]) for b, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if i < j]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _ in rows], pa.int64()),
                        pa.array([chunk] * len(rows), pa.int64()),
                        pa.array([_packed(np.sort(x)) for _, x in rows], pa.binary()),
                        pa.array([_squeezed(b"\n".join([words[k] for k in np.sort(x).tolist()])) for _, x in rows], pa.binary()),
                    ],
                    ["bucket", "chunk", "codes", "words"],
                )

    return run


def _encoded(raw: bytes):
    """The words of a bucket, each encoded once, answered to every chunk that holds it."""

    def run(table: pa.Table) -> pa.Table:
        encode, known, datas = merger(raw).encode, {}, []
        for codes, words in zip(table.column("codes").to_pylist(), table.column("words").to_pylist(), strict=True):
            ids = []
            for w in _restored(words).decode("utf-8", "surrogatepass").split("\n"):
                if w not in known:
                    known[w] = np.array(encode(w), np.uint32)
                ids.append(known[w])
            datas.append(_packed(_unpacked(codes)[0], np.array([len(x) for x in ids]), np.concatenate(ids)))
        release()
        n = len(datas)
        return pa.table({"chunk": table.column("chunk"), "part": pa.array([-1] * n, pa.int32()), "docs": pa.array([[]] * n, pa.list_(pa.int64())), "n": pa.array([0] * n, pa.int64()), "data": pa.array(datas, pa.binary())})

    return run


class Joined:
    """The ids of a chunk's words by code, from the answers of all buckets."""

    def __init__(self):
        self.answers: list[list[np.ndarray]] = []
        self.sizes = None

    def add(self, data: bytes) -> None:
        self.answers.append(_unpacked(data))

    def ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in their order, and how many each word has."""
        if self.sizes is None:
            code, size, self.flat = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (zip(*self.answers, strict=True) if self.answers else ([], [], [])))
            self.sizes, self.places = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
            self.sizes[code], self.places[code] = size, np.cumsum(size.astype(np.int64)) - size
            self.answers = []
        size = self.sizes[codes]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.places[codes] - (ends - size), size) + np.arange(total)], size


def _pieces(raw: bytes) -> pa.Array:
    """The vocabulary's pieces by id."""
    pieces = merger(raw).pieces
    return pa.array([pieces.get(i, "") for i in range(max(pieces) + 1)], pa.string())


def _assembled(raw: bytes):
    """A chunk's answers, then its codes: ids of whole texts, and the pieces that these ids join with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        pieces, chunk, joined = _pieces(raw), None, Joined()
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k].as_py() for c in ("chunk", "part", "docs", "data")}
                if row["chunk"] != chunk:
                    chunk, joined = row["chunk"], Joined()
                if row["part"] < 0:
                    joined.add(row["data"])
                    continue
                counts, codes = _unpacked(row["data"])
                ids, size = joined.ids(codes)
                ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
                for low in range(0, len(counts), 256):  # small batches out
                    at = ends[low : low + 257]
                    part = ids[at[0] : at[-1]]
                    lists = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(part.astype(np.int32)))
                    decoded = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, pieces.take(pa.array(part))), " ")
                    yield pa.RecordBatch.from_arrays([pa.array(row["docs"][low : low + 256], pa.int64()), lists, decoded], ["doc_id", "ids", "decoded"])

    return run


def encode_words(documents: DataFrame, tokenizer: bytes | None = None, p: Params = Params()) -> DataFrame:
    """doc_id, ids and decoded (the pieces of these ids, with a blank between) of every row of documents."""
    raw = tokenizer or read_tokenizer()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = cut(rows.mapInArrow(freed(_coded(raw, p)), ROW))
    lists = coded.where("part < 0")
    buckets = max(1, -(-(lists.agg(F.sum("n")).first()[0] or 0) // p.bucket))
    dealt = lists.select("chunk", "n", "data").mapInArrow(freed(_dealt(buckets)), "bucket long, chunk long, codes binary, words binary")
    answers = dealt.groupBy("bucket").applyInArrow(_encoded(raw), ROW)
    both = answers.unionByName(coded.where("part >= 0"))
    return both.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(freed(_assembled(raw)), "doc_id long, ids array<int>, decoded string")


def decode_words(encoded: DataFrame, tokenizer: bytes | None = None) -> DataFrame:
    """doc_id and decoded of every row of ids: ids joined with the vocabulary's pieces, put back in order.

    Null ids give null, and so does no id but one of the vocabulary; an empty list gives ''.
    """
    pieces = merger(tokenizer or read_tokenizer()).pieces
    spark = encoded.sparkSession
    table = spark.createDataFrame(sorted(pieces.items()), "id int, piece string")
    rows = cut(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.posexplode("ids").alias("place", "id"))
    joined = each.join(F.broadcast(table), "id", "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("found"))
    text = F.when(F.size("ids") == 0, "").when(~F.exists("found", lambda x: x["piece"].isNull()), F.array_join(F.col("found.piece"), " "))
    return rows.join(joined.hint("merge"), "row", "left").select("doc_id", text.alias("decoded"))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids (as decimals with blanks between) and of the decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
