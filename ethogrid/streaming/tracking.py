"""Tracking as an ordered stateful fold: a stream of events a video, and a memory of bounded size.

An event is a row (video, place, kind, frame, height, width, channels, pixels, mask); places count a
video's events from 0 without gaps, in the order in which they take effect, whether frames run forward or
backward. Kinds:

- refer: the frame and its mask become the newest memory, and the only short-term one;
- track: the frame's mask is what the tracker finds by its memories, and is remembered;
- label: tracked like any other, but where the event's mask names an object, it wins, and the frame becomes a reference;
- grow: like label, but the frame becomes a reference only if it shows more objects than are known;
- restart: all memory goes, labels of the start included.

Long-term memory holds the references and every `gap`-th frame, newest first, `blocks` of them; short-term
memory the last `skip` frames, of which the oldest is asked. An event that arrives before the ones that it
follows waits in the state, so files may come in any order and in any number of batches. What a video keeps doesn't grow
with its length. A tracker that finds no memory gives an empty mask.
"""

from __future__ import annotations

import math
import uuid
from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import batched, chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ethogrid.session import checkpointing

COLUMNS = ["place", "kind", "frame", "height", "width", "channels", "pixels", "mask"]
EVENT = "place long, kind string, frame long, height int, width int, channels int, pixels binary, mask binary"
FOUND = "video string, place long, frame long, height int, width int, mask binary"
MEMORY = "features binary, mask binary"


@dataclass(frozen=True)
class Memory:
    """Frames between long-term memories, how many of them, and frames of short-term memory."""

    gap: int = 1_000_000
    blocks: int = 30
    skip: int = 1


class NearestColour:
    """A stand-in for a tracker: the mask of the memory whose mean colour is nearest; of equally near ones the first.

    encode_all is optional in a tracker: the features of several frames of one shape, a row each, as encode gives them. So is
    choose, for trackers whose match gives the mask of one memory: which one, for each of several frames at once, from the features of each
    frame's memories in their order, padded to one number; there tells memories from padding.
    """

    def encode(self, pixels: np.ndarray) -> np.ndarray:
        return pixels.reshape(-1, pixels.shape[-1]).mean(axis=0)

    def encode_all(self, frames: np.ndarray) -> np.ndarray:
        return frames.reshape(len(frames), -1, frames.shape[-1]).mean(axis=1)

    def match(self, features: np.ndarray, memories: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        apart = np.array([f for f, _ in memories]) - features
        return memories[(apart * apart).sum(axis=1).argmin()][1]

    def choose(self, features: np.ndarray, memories: np.ndarray, there: np.ndarray) -> np.ndarray:
        apart = memories - features[:, None]
        return np.where(there, (apart * apart).sum(axis=2), np.inf).argmin(axis=1)


#: Trackers by name; a task builds its own.
TRACKERS: dict[str, Callable[[], object]] = {"nearest_colour": NearestColour}


class Ordered(StatefulProcessor):
    """A fold of a key's events in the order of their places, whatever order they come in.

    Those that come early wait: while a micro-batch lasts in the task, up to `room` bytes of them, else in the state. Each access to
    the state is a call to the JVM, so there are a few a key and micro-batch, and more only for events that wait in it.
    """

    #: Columns of an event, the first of them its place, and their kinds; columns of what is found.
    event: list[str]
    schema: str
    found: list[str]
    #: Only the last of what a batch of a key gives.
    latest = False
    room = 64 << 20

    def start(self, handle: StatefulProcessorHandle) -> None:
        """Name the states of the fold."""

    def load(self) -> None:
        """Take the states of a key; sets place and early, how many events wait in the state."""

    def save(self) -> None:
        """Keep them."""

    def ready(self, events: list) -> list:
        """What can be told of each event before its turn, of all together."""
        return [None] * len(events)

    def take(self, e, ready=None) -> tuple | None:
        """An event's effect, and what it gives besides the key."""

    def take_all(self, due: list[tuple]) -> list[tuple | None]:
        """The same for events and what is ready of them, in their order."""
        return [self.take(e, ready) for e, ready in due]

    def told(self, last: tuple) -> tuple:
        """The last of what a batch of a key gives, made whole."""
        return last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "place long", self.schema)
        self.row = namedtuple("Event", self.event)
        self.start(handle)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.load()
        parked = {k[0] for k in self.waiting.keys()} if self.early else set()
        held: dict[int, tuple] = {}
        size, last = 0, []
        for batch in rows:
            due = []
            events = self._events(batch)
            for e, ready in zip(events, self.ready(events), strict=True):
                if e[0] > self.place:
                    size += sum(len(x) for x in e if isinstance(x, (bytes, bytearray))) + 512 if e[0] not in held else 0
                    held[e[0]] = e, ready
                elif e[0] == self.place:
                    due.append((e, ready))
                    self.place += 1
                    while self.place in held or self.place in parked:
                        at = self.place
                        if at in parked:  # the same event may have come twice
                            found = self.row(*self.waiting.getValue((at,))), None
                            self.waiting.removeKey((at,))
                            parked.remove(at)
                        found = held.pop(at, None) or found
                        due.append(found)
                        self.place += 1
            if not held:
                size = 0
            elif size > self.room:
                self._park(held, parked)
                held, size = {}, 0
            given = [(key[0], *r) for r in self.take_all(due) if r is not None]
            if not self.latest:
                yield pd.DataFrame(given, columns=self.found)
            last = given[-1:] or last
        if self.latest:
            yield pd.DataFrame([self.told(r) for r in last], columns=self.found)
        self._park(held, parked)
        self.early = len(parked)
        self.save()

    def _events(self, batch: pd.DataFrame) -> list:
        """Events in the order of their places; rows may hold a clip of events each, as an array a column."""
        columns = [batch[c].to_numpy() for c in self.event]
        if len(batch) and isinstance(columns[0][0], np.ndarray):
            columns = [np.concatenate(c) for c in columns]
        order = np.argsort(columns[0], kind="stable")
        return list(map(self.row._make, zip(*(c[order].tolist() for c in columns), strict=True)))

    def _park(self, held: dict, parked: set) -> None:
        """Early events go to the state."""
        for at, (e, _) in held.items():
            self.waiting.updateValue((at,), tuple(e))
            parked.add(at)


class Fold(Ordered):
    event, schema = COLUMNS, EVENT
    found = ["video", "place", "frame", "height", "width", "mask"]

    def __init__(self, build: Callable[[], object], memory: Memory):
        self.build, self.memory = build, memory

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.tracker = self.build()
        self.kept = handle.getListState("kept", MEMORY)
        self.recent = handle.getListState("recent", MEMORY)
        self.clock = handle.getValueState("clock", "place long, early long, step long, noted long, objects long")

    def load(self) -> None:
        clock = self.clock.get()
        self.place, self.early, self.step, self.noted, self.objects = clock or (0, 0, 0, 0, 0)
        read = lambda state: [(np.frombuffer(f), np.frombuffer(m, np.uint8)) for f, m in state.get()] if clock else []
        self.long, self.short, self.shape = read(self.kept), read(self.recent), (0, 0)

    def save(self) -> None:
        for state, held in ((self.kept, self.long), (self.recent, self.short)):
            if held:
                state.put([(f.tobytes(), m.tobytes()) for f, m in held])
            else:
                state.clear()
        self.clock.update((self.place, self.early, self.step, self.noted, self.objects))

    def ready(self, events: list) -> list:
        """Features of frames of one shape, about 16 MB of them at a time, if the tracker has a way for several."""
        if not hasattr(self.tracker, "encode_all"):
            return [None] * len(events)
        out: list = []
        for shape, run in groupby(events, key=lambda e: None if e.kind == "restart" else (e.height, e.width, e.channels)):
            if shape is None:
                out += [None for _ in run]
                continue
            shape = tuple(map(int, shape))
            run = list(run)
            for part in batched(run, min(len(run), max(1, (16 << 20) // max(1, math.prod(shape))))):  # batched takes room for all of a part at once
                out += list(np.asarray(self.tracker.encode_all(np.frombuffer(b"".join(e.pixels for e in part), np.uint8).reshape(len(part), *shape)), float))
        return out

    def _note(self, entry: tuple[np.ndarray, np.ndarray]) -> None:
        self.long = [entry, *self.long[: self.memory.blocks - 1]]
        self.noted = self.step

    def _refer(self, features: np.ndarray, mask: bytes) -> None:
        entry = features, np.frombuffer(mask, np.uint8).reshape(self.shape)
        self._note(entry)
        self.short = [entry]
        self.objects = int(entry[1].max(initial=0))

    def _remember(self, features: np.ndarray, mask: bytes) -> None:
        entry = features, np.frombuffer(mask, np.uint8).reshape(self.shape)
        self.short = [*self.short, entry][-self.memory.skip :]
        if self.step - self.noted >= self.memory.gap:
            self._note(entry)

    def _shaped(self, e) -> tuple[int, int]:
        """The event's shape, which the masks of all memories take."""
        if e.height != self.shape[0] or e.width != self.shape[1]:
            self.shape = (int(e.height), int(e.width))
            self.long, self.short = ([(f, m.reshape(self.shape)) for f, m in held] for held in (self.long, self.short))
        return self.shape

    def take_all(self, due: list[tuple]) -> list[tuple | None]:
        """Runs of events of one shape together, if the tracker can choose: which frames are memories when doesn't depend on masks, but for grow."""
        if not hasattr(self.tracker, "choose"):
            return super().take_all(due)
        out: list = []
        for shape, run in groupby(due, key=lambda x: None if x[1] is None or x[0].kind in ("grow", "restart") else (x[0].height, x[0].width, x[0].channels)):
            out += super().take_all(run) if shape is None else self._together(list(run))
        return out

    def _together(self, run: list[tuple]) -> list[tuple | None]:
        shape = self._shaped(run[0][0])
        start = [*self.long, *self.short]
        long, short = tuple(range(len(self.long))), tuple(range(len(self.long), len(start)))
        blocks, skip, gap = self.memory.blocks, self.memory.skip, self.memory.gap
        memories, refers = [], None  # those of each event, as numbers of entries: start's, then the run's
        for at, (e, _) in enumerate(run, len(start)):
            if e.kind == "refer":
                memories.append(())
            else:
                self.step += 1
                memories.append(long + short[:1])
            if e.kind in ("refer", "label"):
                long, short, refers, self.noted = (at, *long[: blocks - 1]), (at,), at, self.step
                continue
            short = (*short, at)[-skip:]
            if self.step - self.noted >= gap:
                long, self.noted = (at, *long[: blocks - 1]), self.step
        features = np.array([*(f for f, _ in start), *(f for _, f in run)])
        chosen = self._chosen(features, len(start), memories)
        masks, blank, out = [m.tobytes() for _, m in start], bytes(math.prod(shape)), []
        for (e, _), of, k in zip(run, memories, chosen, strict=True):
            if e.kind == "refer":
                masks.append(bytes(e.mask))
                out.append(None)
                continue
            mask = masks[of[k]] if of else blank
            if e.kind == "label":
                given = np.frombuffer(e.mask, np.uint8)
                mask = np.where(given > 0, given, np.frombuffer(mask, np.uint8)).tobytes()
            masks.append(mask)
            out.append((e.place, e.frame, *shape, mask))
        # copies, so that a few memories don't hold the features of the whole run
        self.long, self.short = ([(features[i].copy(), np.frombuffer(masks[i], np.uint8).reshape(shape)) for i in held] for held in (long, short))
        if refers is not None:
            self.objects = max(masks[refers], default=0)
        return out

    def _chosen(self, features: np.ndarray, start: int, memories: list[tuple]) -> list[int]:
        """Which of its memories each event takes, about 16 MB of their features at a time."""
        most = max(map(len, memories))
        if not most:
            return [0] * len(memories)
        some, out, row = min(len(memories), max(1, (16 << 20) // max(1, most * features[0].nbytes))), [], start
        for part in batched(memories, some):
            there = np.arange(most) < np.fromiter(map(len, part), np.int64, len(part))[:, None]
            which = np.zeros(there.shape, np.int64)
            which[there] = np.fromiter(chain.from_iterable(part), np.int64)
            out += self.tracker.choose(features[row : row + len(part)], features[which], there).tolist()
            row += len(part)
        return out

    def take(self, e, ready=None) -> tuple | None:
        if e.kind == "restart":
            self.long, self.short, self.step, self.noted, self.objects = [], [], 0, 0, 0
            return None
        shape = self._shaped(e)
        if ready is None:
            ready = np.asarray(self.tracker.encode(np.frombuffer(e.pixels, np.uint8).reshape(*shape, int(e.channels))), float)
        if e.kind == "refer":
            self._refer(ready, bytes(e.mask))
            return None
        self.step += 1
        memories = [*self.long, *self.short[:1]]
        mask = np.asarray(self.tracker.match(ready, memories) if memories else np.zeros(shape), np.uint8)
        if e.kind in ("label", "grow"):
            given = np.frombuffer(e.mask, np.uint8).reshape(shape)
            mask = np.where(given > 0, given, mask)
        found = mask.tobytes()
        if e.kind == "label" or e.kind == "grow" and int(mask.max(initial=0)) > self.objects:
            self._refer(ready, found)
        else:
            self._remember(ready, found)
        return e.place, e.frame, *shape, found

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.load()
        for r in initialState.itertuples(index=False):
            for label in r.labels:
                self.shape = label["height"], label["width"]
                image = np.frombuffer(label["pixels"], np.uint8).reshape(label["height"], label["width"], label["channels"])
                self._refer(np.asarray(self.tracker.encode(image), float), bytes(label["mask"]))
        self.save()


def _stored(spark: SparkSession) -> None:
    """The state store that these states need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def track(events: DataFrame, tracker: str, memory: Memory = Memory(), labels: DataFrame | None = None) -> DataFrame:
    """FOUND rows of the tracked frames of a stream of events.

    labels (video, frame, height, width, channels, pixels, mask) are known before the first event, as
    references in the order of their frames; of more than memory.blocks a video, the last ones.
    """
    _stored(events.sparkSession)
    start = None
    if labels is not None:
        newest = Window.partitionBy("video").orderBy(F.desc("frame"))
        last = labels.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= memory.blocks)
        packed = last.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("frame", "height", "width", "channels", "pixels", "mask"))).alias("labels"))
        start = packed.groupBy("video")
    return events.select("video", *COLUMNS).groupBy("video").transformWithStateInPandas(Fold(TRACKERS[tracker], memory), FOUND, "append", "None", initialState=start)


def scheduled(frames: DataFrame, start: int, stop: int) -> DataFrame:
    """The events that track the frames from start to stop, both included; backward if start is beyond stop."""
    low, high = min(start, stop), max(start, stop)
    step = F.col("frame") if start <= stop else -F.col("frame")
    rows = frames.where(F.col("frame").between(low, high)).withColumn("at", step)
    return numbered(rows.select("video", "at", F.lit(0).alias("after"), F.lit("track").alias("kind"), "frame", "height", "width", "channels", "pixels", F.lit(None).cast("binary").alias("mask")))


def numbered(rows: DataFrame, block: int = 4096) -> DataFrame:
    """Events with their places: each video's rows by (at, after), counted from 0.

    A video is counted in blocks of `at`, so that none of them, however long, is sorted in one task.
    """
    spread = rows.withColumn("block", F.floor(F.col("at") / block))
    sizes = spread.groupBy("video", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("video").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("video", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("video", "block").orderBy("at", "after")) - 1
    return spread.withColumn("inside", inside).join(starts, ["video", "block"]).withColumn("place", F.col("start") + F.col("inside")).drop("block", "inside", "start", "at", "after")


def _packer(key: str, clip: int):
    """Sorted rows as clips: rows that follow each other, of one key and part, with places of one multiple of clip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, bool)
            at = batch.column("place").to_numpy() // clip
            new[1:] = at[1:] != at[:-1]
            for c in (key, "part"):
                of = batch.column(c)
                new[1:] |= pc.fill_null(pc.not_equal(of[1:], of[:-1]), True).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            offsets = pa.array(np.append(first, batch.num_rows), pa.int32())
            columns = [batch.column(c).take(pa.array(first)) if c in (key, "part") else pa.ListArray.from_arrays(offsets, batch.column(c)) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def streamed(events: DataFrame, span: int = 32_768, files: int = 8, clip: int = 1) -> DataFrame:
    """The events as a stream of files: each holds `span` places of a share of the videos, in order, and a micro-batch reads
    `files` of them, those of lower places first. So events hardly ever wait, and no micro-batch grows with a video's length.

    With clip, a row holds the events of so many places at most, as an array a column: for small frames, as each row on its way
    to a fold costs more than they do. A clip should be a few MB at most.
    """
    spark = checkpointing(events.sparkSession)
    key = "video" if "video" in events.columns else "session"
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/events-{uuid.uuid4().hex}"
    rows = events.withColumn("part", F.floor(F.col("place") / span))
    dealt = rows.repartition("part", F.pmod(F.xxhash64(key), F.lit(files))).sortWithinPartitions("part", key, "place")
    if clip > 1:
        of = [f for f in events.schema if f.name != key]
        schema = StructType([StructField(key, events.schema[key].dataType), *(StructField(f.name, ArrayType(f.dataType)) for f in of), StructField("part", LongType())])
        dealt = dealt.select(*schema.names).mapInArrow(_packer(key, clip), schema)
    dealt.write.partitionBy("part").parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files_of = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for below in files_of.listStatus(folder):
        if below.getPath().getName().startswith("part="):
            found += [(int(below.getPath().getName()[5:]), s.getModificationTime(), s.getPath()) for s in files_of.listStatus(below.getPath()) if s.getPath().getName().startswith("part-")]
    begin = max((at for _, at, _ in found), default=0)
    for part, _, file in found:  # a stream takes older files first; where a store keeps its own times, events wait in the state
        files_of.setTimes(file, begin + part, -1)
    schema = dealt.schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).drop("part")
