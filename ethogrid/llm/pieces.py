"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

The automaton's output links list every piece that ends at a position; each relaxes the best score
there, so one pass finds the segmentation with the highest sum of piece scores (among equal sums,
the one whose last piece is longest, position by position). Characters that no piece covers cost
`unknown` and are written as byte pieces. The pieces' meta symbol U+2581 stands for a blank, and one
is put before the text, as the model's own settings say. No piece holds a blank after another
character (checked when the model is read; if one did, texts would be encoded whole), so a text
falls into chunks, each a run of blanks and the bytes after it, that are encoded by themselves;
equal chunks of a batch are encoded once. A long chunk, as of writing without blanks, is cut further between
neighbouring characters that no piece holds together. Memory is bounded by a batch and its chunks.

Decoding is exact: decode(encode(text)) == text for every text, white space,
control and astral characters included; a U+2581 of the text itself is encoded by its bytes. Null texts give null ids and null back, empty texts an empty list and ''.
Unlike the model's trainer, no normalisation or merging of blanks is done. Repeated rows give equal
results, one for each row. An empty table gives no rows. Only doc_id and text (or ids) are read, so other
columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._memory import freed, release

META = "▁"
#: Texts with a run like this hold long chunks.
LONG = re.compile(rb"[^ ]{200}")
#: Where the public tokenizers lie on this machine, unless a path is given.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id. Byte pieces, control symbols and the unknown symbol don't match text."""

    texts: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[bool, ...]
    bytes_at: int
    unknown: float

    @classmethod
    def read(cls, model: bytes) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(m.get_piece_size())
        normal = tuple(not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in ids)
        scores = tuple(max(m.get_score(i), -1e6) for i in ids)
        return cls(tuple(m.id_to_piece(i) for i in ids), scores, normal, m.piece_to_id("<0x00>"), min(s for s, ok in zip(scores, normal, strict=True) if ok) - 10.0)


class Automaton:
    """An Aho-Corasick automaton over byte strings with all its moves in one table."""

    def __init__(self, patterns: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        parent, symbol, depth, output = [0], [0], [0], [-1]
        for pattern, value in patterns.items():
            state = 0
            for byte in pattern:
                after = children[state].get(byte)
                if after is None:
                    after = children[state][byte] = len(children)
                    children.append({})
                    parent.append(state)
                    symbol.append(byte)
                    depth.append(depth[state] + 1)
                    output.append(-1)
                state = after
            output[state] = value
        self.output = np.array(output, np.int32)
        parent, symbol, depth = np.array(parent), np.array(symbol), np.array(depth)
        n = len(depth)
        self.move = np.zeros((n, 256), np.int32)
        self.move[parent[1:], symbol[1:]] = np.arange(1, n)
        fail = np.zeros(n, np.int64)
        #: The nearest shorter suffix's state that has an output; 0 where there is none.
        self.link = np.zeros(n, np.int32)
        for d in range(1, int(depth.max()) + 1):
            level = np.flatnonzero(depth == d)
            if d > 1:
                fail[level] = self.move[fail[parent[level]], symbol[level]]
            suffix = fail[level]
            self.link[level] = np.where(self.output[suffix] >= 0, suffix, self.link[suffix])
            own = self.move[level]
            self.move[level] = np.where(own > 0, own, self.move[suffix])


class Codec(dict):
    """Encoder and decoder of one vocabulary; as a dict, the chunks seen so far, about `memory` at most."""

    def __init__(self, vocabulary: Vocabulary, memory: int = 150_000):
        super().__init__()
        self.v, self.memory = vocabulary, memory
        byte = lambda i: bytes([i - vocabulary.bytes_at]) if 0 <= i - vocabulary.bytes_at < 256 else b""
        raw = [t.replace(META, " ").encode() if ok else byte(i) for i, (t, ok) in enumerate(zip(vocabulary.texts, vocabulary.normal, strict=True))]
        own = {r: i for i, (r, ok) in enumerate(zip(raw, vocabulary.normal, strict=True)) if ok}
        self.automaton = Automaton(own)
        self.scores = np.array([*vocabulary.scores, vocabulary.unknown])
        self.chunks = re.compile(b".+" if any(b" " in r.lstrip(b" ") for r in own) else b" +[^ ]*", re.DOTALL).findall
        points = [np.frombuffer(r.decode().encode("utf-32-le"), np.uint32).astype(np.uint64) for r in own]
        #: Neighbouring characters of which some piece holds both; no piece crosses a place between others.
        self.bonds = np.unique(np.concatenate([(x[:-1] << np.uint64(32)) | x[1:] for x in points]))
        self.table = np.frombuffer(b"".join(raw), np.uint8)
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes

    def pieced(self, chunk: bytes, least: int = 200) -> list[bytes]:
        """A chunk cut where no piece can cross, if it is long; the best segmentations of its parts make that of the whole."""
        if len(chunk) < least:
            return [chunk]
        x = np.frombuffer(chunk.decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
        pair = (x[:-1] << np.uint64(32)) | x[1:]
        at = np.minimum(np.searchsorted(self.bonds, pair), len(self.bonds) - 1)
        size = 1 + (x >= 0x80) + (x >= 0x800) + (x >= 0x10000)
        cuts = [0, *np.cumsum(size)[:-1][self.bonds[at] != pair].tolist(), len(chunk)]
        return [chunk[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def viterbi(self, chunks: list[bytes]) -> list[bytes]:
        """Ids (as 32-bit integers) of the best segmentation of each chunk; the longest chunks come first.

        All chunks step through the automaton together. At each position the output links are
        followed, and every piece that ends there relaxes the best score.
        """
        sizes = np.array([len(c) for c in chunks])
        n, most = len(chunks), int(sizes[0])
        grid = np.zeros((most, n), np.uint8)
        data = np.frombuffer(b"".join(chunks), np.uint8)
        owner = np.repeat(np.arange(n), sizes)
        grid[np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner] = data
        move, link, output, unknown = self.automaton.move, self.automaton.link, self.automaton.output, len(self.v.texts)
        best = np.full((most + 1, n), -1e18)
        best[0] = 0
        back, step = np.full((most + 1, n), unknown, np.int32), np.zeros((most + 1, n), np.int16)
        state, begun = np.zeros(n, np.int32), np.zeros(n, np.int64)
        for k in range(most):
            alive = int(np.searchsorted(-sizes, -k, "left"))
            byte = grid[k, :alive]
            begun[:alive] = np.where((byte & 0xC0) != 0x80, k, begun[:alive])  # where this character begins
            now = state[:alive] = move[state[:alive], byte]
            top, now = best[k + 1], np.where(output[now] >= 0, now, link[now])
            at = np.flatnonzero(now)
            while len(at):
                here = now[at]
                piece = output[here]
                total = best[k + 1 - self.sizes[piece], at] + self.scores[piece]
                better = total > top[at]
                won = at[better]
                top[won], back[k + 1, won], step[k + 1, won] = total[better], piece[better], self.sizes[piece[better]]
                now[at] = link[here]
                at = at[now[at] > 0]
            whole = np.ones(alive, bool)
            if k + 1 < most:
                whole = ((grid[k + 1, :alive] & 0xC0) != 0x80) | (sizes[:alive] == k + 1)
            total = np.where(whole, best[begun[:alive], np.arange(alive)] + self.v.unknown, -1e18)
            won = np.flatnonzero(total > top[:alive])
            top[won], back[k + 1, won], step[k + 1, won] = total[won], unknown, (k + 1 - begun[:alive])[won]
        place, alive = sizes.copy(), np.arange(n)
        owners, ids, places = [], [], []
        while len(alive):
            owners.append(alive)
            ids.append(back[place[alive], alive])
            places.append(place[alive])
            place[alive] -= step[place[alive], alive]
            alive = alive[place[alive] > 0]
        owner, piece, place = (np.concatenate(x)[::-1] for x in (owners, ids, places))
        order = np.argsort(owner, kind="stable")
        owner, piece, place = owner[order], piece[order], place[order]
        bounds = np.searchsorted(owner, np.arange(n + 1)).tolist()
        odd = set(owner[piece == unknown].tolist())
        flat = piece.astype(np.int32).tobytes()
        return [
            flat[4 * bounds[k] : 4 * bounds[k + 1]] if k not in odd else self._with_bytes(chunks[k], piece[bounds[k] : bounds[k + 1]], place[bounds[k] : bounds[k + 1]])
            for k in range(n)
        ]

    def _with_bytes(self, chunk: bytes, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """Ids in which an unknown character is written as its bytes."""
        out: list[int] = []
        low = 0
        for i, high in zip(ids.tolist(), ends.tolist(), strict=True):
            out += [i] if i < len(self.v.texts) else [self.v.bytes_at + b for b in chunk[low:high]]
            low = high
        return np.array(out, np.int32).tobytes()

    def encode(self, texts: list[bytes | None], cells: int = 1 << 18) -> list[bytes | None]:
        """The ids of each UTF-8 text as 32-bit integers; chunks that weren't seen before are encoded together."""
        if len(self) > self.memory:
            self.clear()
        parts = [None if t is None else self.chunks(b" " + t) if t else [] for t in texts]
        for k, t in enumerate(texts):
            if t and LONG.search(t):
                parts[k] = [x for c in parts[k] for x in self.pieced(c)]
        new = sorted(set().union(*(x for x in parts if x)) - self.keys(), key=len, reverse=True)
        low = 0
        while low < len(new):
            high = low + max(1, cells // len(new[low]))
            self.update(zip(new[low:high], self.viterbi(new[low:high]), strict=True))
            low = high
        return [None if x is None else b"".join(map(self.__getitem__, x)) for x in parts]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of the id lists ids[offsets[k]:offsets[k + 1]], each without the blank put before it."""
        size = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = self.table[np.repeat(self.places[ids] - ends[:-1], size) + np.arange(ends[-1])]
        at = ends[offsets]
        keep = np.ones(len(out), bool)
        lead = at[:-1][(at[1:] > at[:-1])]
        keep[lead[out[lead] == 0x20]] = False
        return out[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def _lists(column: pa.ListArray, part: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, ids, offsets) of runs of whole lists of about `part` ids."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + part, "right")) - 1)
        yield low, high, values[offsets[low] : offsets[high]], (offsets[low : high + 1] - offsets[low]).astype(np.int64)
        low = high


def _encoder(model: bytes, round_trip: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        codec = Codec(Vocabulary.read(model))
        for batch in (whole.slice(low, 1024) for whole in batches for low in range(0, len(whole), 1024)):  # small rows out
            column = batch.column("text")
            ids = [i for low in range(0, len(column), 256) for i in codec.encode(column.slice(low, 256).cast(pa.binary()).to_pylist())]
            offsets = np.concatenate([[0], np.cumsum([len(i) // 4 if i else 0 for i in ids])])
            values = np.frombuffer(b"".join(i for i in ids if i), np.int32)
            null = np.array([i is None for i in ids], bool)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=pa.array(null))
            keep = [c for c in batch.schema.names if c != "text"]
            extra = [lists]
            if round_trip:
                exact = np.zeros(len(ids), bool)
                for low, high, part, at in _lists(lists):
                    raw, have = B.utf8(column.slice(low, high - low))
                    out, got = codec.decode(part, at)
                    exact[low:high] = [np.array_equal(out[got[k] : got[k + 1]], raw[have[k] : have[k + 1]]) for k in range(high - low)]
                extra.append(pa.array(exact, mask=null))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + extra, keep + ["ids", "exact"][: len(extra)])

    return run


def _decoder(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Vocabulary.read(model))
        for batch in batches:
            column = batch.column("ids")
            null, texts = column.is_null().to_pylist(), []
            for low, high, part, at in _lists(column):
                out, got = codec.decode(part, at)
                raw = out.tobytes()
                texts += [None if null[low + k] else raw[got[k] : got[k + 1]].decode("utf-8", "replace") for k in range(high - low)]
            keep = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string())], [*keep, "decoded"])

    return run


def read_model(path: str = MODEL) -> bytes:
    """The model file's bytes, read by the driver; they travel with the tasks (half a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def encode_pieces(documents: DataFrame, model: bytes | None = None, check: bool = True) -> DataFrame:
    """doc_id, ids and, with check, exact: whether decoding the ids gave the text back."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(freed(_encoder(model or read_model(), check)), "doc_id long, ids array<int>" + ", exact boolean" * check)


def decode_pieces(encoded: DataFrame, model: bytes | None = None) -> DataFrame:
    """doc_id and decoded of every row of ids."""
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(freed(_decoder(model or read_model())), "doc_id long, decoded string")
