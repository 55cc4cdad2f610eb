"""Linking detections as they arrive."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Tracking
from ..operators.linking import link_step

OUT = "run_id long, frame int, x int, y int, theta double, particle int"
STATE = "frame int, x double, y double, particle int"


def _step(search_range: float, idle: int):
    def run(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        frame, x, y, particle = state.get if state.exists else (None, 0.0, 0.0, -1)
        rows = pd.concat(list(batches)).sort_values("frame")
        numbers = []
        for r in rows.itertuples():
            if frame is not None and r.frame <= frame:
                numbers.append(-1)
                continue
            if frame is None or r.frame != frame + 1 or ((r.x - x) ** 2 + (r.y - y) ** 2) ** 0.5 > search_range:
                particle += 1
            frame, x, y = int(r.frame), float(r.x), float(r.y)
            numbers.append(particle)
        state.update((frame, x, y, particle))
        if idle:
            state.setTimeoutDuration(idle * 1000)
        yield rows.assign(particle=numbers)[["run_id", "frame", "x", "y", "theta", "particle"]]

    return run


def link_stream(detections: DataFrame, search_range: float = Tracking.search_range, idle: int = 0) -> DataFrame:
    """particle of a stream of detections (run_id, frame, x, y, theta), one bot a run, frames of a run in order. What
    is kept of a run is its last row, with `idle` for so many seconds after it (a run that goes on later counts its
    particles from 0 again). A row that comes after a later frame of its run was linked is late: its particle is -1."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return detections.groupBy("run_id").applyInPandasWithState(_step(search_range, idle), OUT, STATE, "append", timeout)


POINT = "frame int, x int, y int, theta double"


class Linker(StatefulProcessor):
    """Links the bots of one run as its rows arrive. Rows wait until `delay` frames after theirs have been seen, so they may come in any order
    within that; then frames are linked in turn, as in a batch. A timer links what still waits when no row has come for `idle` seconds."""

    def __init__(self, search_range: float, delay: int, idle: float):
        self.search_range, self.delay, self.idle = search_range, delay, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", POINT)
        self.points = handle.getListState("points", "x int, y int, particle int")
        self.place = handle.getValueState("place", "frame int, free int, newest int")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.frame), int(r.x), int(r.y), float(r.theta)) for part in rows for r in part.itertuples()]
        last, free, newest = self.place.get() if self.place.exists() else (None, 0, -1)
        late = [r for r in new if last is not None and r[0] <= last]
        newest = max([newest, *(r[0] for r in new)])
        yield from self._out(key, [(*r, -1) for r in late])
        yield from self._link(key, [*self.waiting.get(), *(r for r in new if last is None or r[0] > last)], last, free, newest, newest - self.delay)
        if self.idle:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.idle))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.place.exists():
            last, free, newest = self.place.get()
            yield from self._link(key, list(self.waiting.get()), last, free, newest, newest)

    def _link(self, key, rows: list[tuple], last: int | None, free: int, newest: int, until: int) -> Iterator[pd.DataFrame]:
        rows = sorted(map(tuple, rows))
        points, out = [tuple(p) for p in self.points.get()], []
        ready = [r for r in rows if r[0] <= until]
        for frame, group in itertools.groupby(ready, key=lambda r: r[0]):
            now = list(group)
            before = points if last is not None and frame == last + 1 else []
            xy = lambda ps, a: np.array([p[a : a + 2] for p in ps], float).reshape(-1, 2)
            found = link_step(xy(before, 0), xy(now, 1), self.search_range)
            points, last = [], frame
            for i, r in enumerate(now):
                particle = before[found[i]][2] if i in found else free
                free += i not in found
                points.append((r[1], r[2], particle))
                out.append((*r, particle))
        self.waiting.put(rows[len(ready) :]) if len(rows) > len(ready) else self.waiting.clear()
        self.points.put(points) if points else self.points.clear()
        self.place.update((last if last is not None else -1, free, newest))
        yield from self._out(key, out)

    def _out(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=[c.split()[0] for c in OUT.split(", ")])


def link_stream_many(detections: DataFrame, search_range: float = Tracking.search_range, delay: int = 8, idle: float = 0) -> DataFrame:
    """particle of a stream of detections (run_id, frame, x, y, theta) with any number of bots a run. Rows may arrive in any order
    within `delay` frames; with that, particles are those of linking.link(). A row that comes later than that gets -1. What is kept of a run is its
    last frame and the rows that wait. Needs the state store of RocksDB."""
    return detections.groupBy("run_id").transformWithStateInPandas(Linker(search_range, delay, idle), OUT, "append", "ProcessingTime" if idle else "None")
