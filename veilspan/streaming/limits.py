"""Limits, breakers, expiry and heartbeats as streams: one small state value for each key.

The rules are those of the batch operators. A key's rows wait in state until the watermark has passed them, and are then taken
in order of time and id, however many batches or files they came in; rows later than the watermark's delay are
dropped, as Spark drops them. Keys are dealt to GROUPS groups by their hash: what a batch brings of a group waits as one value,
under one timer, since frames, timers and rows of the store for each key would cost far more than the fold.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilspan import session
from veilspan.operators.routing import Breaker, Bucket


#: Groups of keys; fixed, since the state of a stream hangs on it.
GROUPS = 1024


class _InOrder(StatefulProcessor):
    """Folds each key's rows in event order: `due_ms` is when the watermark has passed a row. One timer waits for a group's first.
    Rows wait as JSON lists of FIELDS and the key; each key of a group has its own state."""

    STATE, FIELDS, OUT = "", (), ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("state", "key string", self.STATE)
        self.waiting = handle.getListState("waiting", "rows string")
        self.timer = handle.getValueState("timer", "due long")

    def fold(self, held: tuple | None, rows: list[list]) -> tuple[list[tuple], tuple]:
        """What is said of a key's rows and its new state."""
        raise NotImplementedError

    def _wait_for(self, due: int) -> None:
        if (held := self.timer.get()) is not None:
            if held[0] <= due:
                return
            self.handle.deleteTimer(held[0])
        self.timer.update((due,))
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            own = [_plain(frame[c]) for c in (*self.FIELDS, "key")]
            self.waiting.appendValue((json.dumps(list(zip(*own, strict=True)), default=lambda v: v.item()),))
            self._wait_for(int(frame["due_ms"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, ready, later = timerValues.getCurrentWatermarkInMs(), {}, []
        for (packed,) in self.waiting.get():
            for row in json.loads(packed):
                if row[0] <= now:
                    ready.setdefault(row[-1], []).append(row[:-1])
                else:
                    later.append(row)
        self.timer.clear()
        if later:
            self.waiting.put([(json.dumps(later),)])
            self._wait_for(int(min(r[0] for r in later)))
        else:
            self.waiting.clear()
        out = []
        for own, waited in ready.items():
            place = (json.dumps(own),)
            said, held = self.fold(self.state.getValue(place), sorted(waited, key=lambda r: (r[1], r[2])))
            self.state.updateValue(place, held)
            out += [(own, *row) for row in said]
        yield pd.DataFrame(out, columns=["key", *self.OUT])

    def close(self) -> None:
        pass


def _plain(column: pd.Series) -> list:
    """A column's values, nulls as None."""
    return column.tolist() if not column.hasnans else [None if v is None or v != v else v for v in column.tolist()]


class Limiter(_InOrder):
    STATE = "tokens double, last double"
    FIELDS, OUT = ("due_ms", "at", "id"), ("id", "allowed", "tokens", "retry_after_ms")

    def __init__(self, rate: float, burst: float):
        self.bucket = Bucket(rate, burst)

    def fold(self, held: tuple | None, rows: list[list]) -> tuple[list[tuple], tuple]:
        state = {} if held is None else dict(zip(("tokens", "last"), held, strict=True))
        out = [(i, *self.bucket.step(state, at)) for _, at, i in rows]
        return out, (state["tokens"], state["last"])


class Guard(_InOrder):
    STATE = "fails int, opened double"
    FIELDS, OUT = ("due_ms", "at", "id", "failed"), ("id", "state", "allowed")

    def __init__(self, threshold: int, open_seconds: float):
        self.breaker = Breaker(threshold, open_seconds)

    def fold(self, held: tuple | None, rows: list[list]) -> tuple[list[tuple], tuple]:
        state = Breaker.start() if held is None else dict(zip(("fails", "opened"), held, strict=True))
        out = [(i, *self.breaker.step(state, at, bool(failed))) for _, at, i, failed in rows]
        return out, (state["fails"], state["opened"])


class Deadline(StatefulProcessor):
    """One timer for each key, at `until_ms` of its last row by (at, id), or with `latest` at the latest of its rows; the key
    is emitted when the watermark passes it, and a later row starts it anew."""

    def __init__(self, latest: bool):
        self.latest = latest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "due long, at double, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        best = held and tuple(held)
        for frame in rows:
            for r in frame[["until_ms", "at", "id"]].itertuples(index=False, name=None):
                if best is None or (r[0] > best[0] if self.latest else r[1:] > best[1:]):
                    best = (int(r[0]), float(r[1]), int(r[2]))
        if held is None or best[0] != held[0]:
            if held is not None:
                self.handle.deleteTimer(held[0])
            self.handle.registerTimer(best[0])
        self.state.update(best)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.state.get()[0]
        self.state.clear()
        yield pd.DataFrame({"key": [key[0]], "due_ms": [due]})

    def close(self) -> None:
        pass


def _dated(rows: DataFrame, delay: str) -> DataFrame:
    """Rows with a watermark on ts and the millisecond, rounded up, at which it has passed them."""
    session.ship_package(rows.sparkSession)
    return rows.withColumn("due_ms", F.ceil(F.unix_micros("ts") / 1000)).withWatermark("ts", delay)


def _in_groups(rows: DataFrame, delay: str, processor: _InOrder, schema: str) -> DataFrame:
    dated = _dated(rows, delay).select(F.pmod(F.xxhash64("key"), F.lit(GROUPS)).alias("part"), "key", "ts", *processor.FIELDS)
    return dated.groupBy("part").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def limit_stream(requests: DataFrame, rate: float, burst: float, delay: str = "0 seconds") -> DataFrame:
    """A stream of (key, id, at, ts) to one of (key, id, allowed, tokens, retry_after_ms), once the watermark on ts has passed a request."""
    return _in_groups(requests, delay, Limiter(rate, burst), "key string, id long, allowed boolean, tokens double, retry_after_ms long")


def guard_stream(calls: DataFrame, threshold: int = 5, open_seconds: float = 30.0, delay: str = "0 seconds") -> DataFrame:
    """A stream of (key, id, at, ts, failed) to one of (key, id, state, allowed), once the watermark on ts has passed a call."""
    return _in_groups(calls, delay, Guard(threshold, open_seconds), "key string, id long, state string, allowed boolean")


def offline_stream(beats: DataFrame, interval: float = 30.0, missed: int = 3, delay: str = "0 seconds") -> DataFrame:
    """A stream of heartbeats (key, id, at, ts) to the keys that went silent for `missed` intervals, with when they were due."""
    due = beats.withColumn("until_ms", F.unix_millis("ts") + int(interval * missed * 1000))
    return due.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(Deadline(True), "key string, due_ms long", "Append", "EventTime")


def expiry_stream(entries: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """A stream of vault writes (key, id, at, ts, until_ms) to the entries whose time is past; the last write of a key counts."""
    return entries.where(F.col("until_ms").isNotNull()).withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(Deadline(False), "key string, due_ms long", "Append", "EventTime")
