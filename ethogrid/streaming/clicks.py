"""Click sessions as an ordered fold: masks of several ROIs from clicks that add and remove.

An event is a row (session, place, kind, x, y). A click ('add' or 'remove') is of the ROI at hand; the first
click of a session, and the first after 'next', begins a ROI with the next number. A click's mask is the
segmenter's, from all clicks of its ROI, over the ROIs before; so only the last click of a ROI shapes it, and later
ROIs cover earlier ones. The state is an image, the clicks of one ROI and three numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessorHandle

from .tracking import Ordered, _stored


class Boxes:
    """A stand-in for a segmenter: a box about each click that adds, less the boxes about those that remove."""

    def __init__(self, reach: int = 2):
        self.reach = reach

    def segment(self, shape: tuple[int, int], clicks: list[tuple[int, int, bool]]) -> np.ndarray:
        out = np.zeros(shape, bool)
        for adds in (True, False):
            for x, y, add in clicks:
                if add == adds:
                    out[max(y - self.reach, 0) : y + self.reach + 1, max(x - self.reach, 0) : x + self.reach + 1] = add
        return out


#: Segmenters by name; a task builds its own.
SEGMENTERS: dict[str, Callable[[], object]] = {"boxes": Boxes}


class Session(Ordered):
    event, schema = ["place", "kind", "x", "y"], "place long, kind string, x int, y int"
    found = ["session", "place", "roi", "mask"]

    def __init__(self, build: Callable[[], object], height: int, width: int, latest: bool):
        self.build, self.shape, self.latest = build, (height, width), latest

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.segmenter = self.build()
        self.kept = handle.getValueState("kept", "place long, early long, roi int, fresh boolean, before binary, now binary, xs array<int>, ys array<int>, adds array<boolean>")

    def load(self) -> None:
        blank = bytes(self.shape[0] * self.shape[1])
        self.place, self.early, self.roi, self.fresh, before, now, *clicks = self.kept.get() or (0, 0, 0, True, blank, blank, [], [], [])
        self.before, self.now, self.clicks, self.drawn = bytes(before), bytes(now), list(zip(*clicks, strict=True)), True

    def save(self) -> None:
        self._draw()
        xs, ys, adds = map(list, zip(*self.clicks, strict=True)) if self.clicks else ([], [], [])
        self.kept.update((self.place, self.early, self.roi, self.fresh, self.before, self.now, xs, ys, adds))

    def _draw(self) -> None:
        """The mask after the clicks so far."""
        if not self.drawn:
            hit = np.asarray(self.segmenter.segment(self.shape, self.clicks), bool)
            self.now = np.where(hit, self.roi, np.frombuffer(self.before, np.uint8).reshape(self.shape)).astype(np.uint8).tobytes()
            self.drawn = True

    def take(self, e, ready=None) -> tuple | None:
        if e.kind == "next":
            self._draw()
            self.before, self.clicks, self.fresh = self.now, [], True
            return None
        self.roi, self.fresh = self.roi + self.fresh, False
        self.clicks.append((int(e.x), int(e.y), e.kind == "add"))
        self.drawn = False
        self._draw()
        return e.place, self.roi, self.now

    def take_all(self, due: list[tuple]) -> list[tuple | None]:
        """The clicks of a ROI together, if latest: only the last of them, and of a micro-batch, is drawn."""
        if not self.latest:
            return super().take_all(due)
        out: list = []
        for ends, run in groupby((e for e, _ in due), key=lambda e: e.kind == "next"):
            if ends:
                out += [self.take(e) for e in run]
                continue
            run = list(run)
            self.roi, self.fresh, self.drawn = self.roi + self.fresh, False, False
            self.clicks += [(int(e.x), int(e.y), e.kind == "add") for e in run]
            out.append((run[-1].place, self.roi))
        return out

    def told(self, last: tuple) -> tuple:
        self._draw()
        return *last, self.now


def click_masks(events: DataFrame, segmenter: str, height: int, width: int, latest: bool = False) -> DataFrame:
    """session, place, roi, mask after every click of a stream of events, or (latest) after the clicks of each micro-batch; a
    session may have 255 ROIs."""
    _stored(events.sparkSession)
    processor = Session(SEGMENTERS[segmenter], height, width, latest)
    return events.select("session", *Session.event).groupBy("session").transformWithStateInPandas(processor, "session string, place long, roi int, mask binary", "append", "None")
