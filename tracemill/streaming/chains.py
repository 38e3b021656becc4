"""Failure chains and compaction boundaries as state machines over a stream.

A stream may bring a scope's records late and out of order, within the watermark's delay. Records wait in a list
until the watermark has passed them; a timer of event time wakes the scope then, and they are folded in order. What
a fold holds open (a run of failures, chains without an answer, a boundary) is value and map state. A scope without
records for ``idle`` is closed by its timer: open chains end without an answer, and its state is gone. So state is
bounded by the scopes that are alive, and results don't depend on how records fell into batches.

Defined results: records later than the watermark are dropped by Spark; records of equal time are in the order of
their id, a null id being the least long; a record without a time never leaves the source (``timed``); a null tool fails and answers
for itself like any other name. A scope that goes on after it was closed starts anew.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHAIN = "scope string, tool string, failures long, first_failure long, last_failure long, response long, next_outcome string"
BOUNDARY = "scope string, boundary long, records long, first_record long, last_record long, kinds array<string>"
_NONE = "\x00"  # a map's keys aren't null


class Ordered(StatefulProcessor):
    """Keeps records until the watermark passes them and hands them on in order; ``step`` and ``finish`` give rows."""

    columns: list[str]
    pending: str

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.pending)
        self.clock = handle.getValueState("clock", "timer long, last long, first long")
        self.open(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(None if pd.isna(x) else x for x in r) for frame in rows for r in frame[self.columns].astype(object).itertuples(index=False)]
        return self._advance(key, timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._advance(key, timerValues.getCurrentWatermarkInMs(), [])

    def _advance(self, key: tuple, watermark: int, new: list[tuple]) -> Iterator[pd.DataFrame]:
        """State is asked for over a socket: once for a call what is folded, and what waits only when some of it is due."""
        clock = self.clock.get()
        timer, last, first = clock or (-1, -1, None)
        due = [r[0] // 1000 for r in new] + [first] * (first is not None)
        out: list[tuple] = []
        if due and min(due) > watermark and not (last >= 0 and watermark - last >= self.idle):
            if new:
                self.waiting.appendList(new)
            first = min(due)
        else:
            held = sorted([*(() if first is None else self.waiting.get()), *new], key=lambda r: r[:2])
            n = sum(r[0] // 1000 <= watermark for r in held)
            self.load(clock is None)
            for k, r in enumerate(held):
                at = r[0] // 1000
                if last >= 0 and at - last >= self.idle and (k < n or watermark - last >= self.idle):
                    out += self.finish()  # the gap before this record ended what was open
                if k >= n:
                    break
                out += self.step(*r[1:])
                last = at
            rest = held[n:]
            if rest:
                self.waiting.put(rest)
            elif first is not None:
                self.waiting.clear()
            first = rest[0][0] // 1000 if rest else None
            if not rest and last >= 0 and watermark - last >= self.idle:
                out += self.finish()
                last = -1
            self.save()
        wake = first + 1 if first is not None else last + self.idle + 1 if last >= 0 else -1
        if wake != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if wake >= 0:
                self.handle.registerTimer(wake)
        if wake >= 0 or last >= 0:
            self.clock.update((wake, last, first))
        elif clock:
            self.clock.clear()
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=self.names)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def load(self, fresh: bool) -> None:
        """Reads what is held open; a fresh scope has nothing."""
        raise NotImplementedError

    def save(self) -> None:
        """Writes what has changed since."""
        raise NotImplementedError

    def step(self, *record) -> list[tuple]:
        raise NotImplementedError

    def finish(self) -> list[tuple]:
        """What is open when a scope ends; leaves no state."""
        raise NotImplementedError


class FailureChains(Ordered):
    """Consecutive failures of one tool, then that tool's next operation, whenever it comes."""

    columns = ["at", "id", "tool", "failed"]
    pending = "at long, id long, tool string, failed boolean"
    names = [c.split()[0] for c in CHAIN.split(", ")]

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "tool string, failures long, first long, last long")
        self.unanswered = handle.getMapState("unanswered", "tool string", "failures long, first long, last long")

    def load(self, fresh: bool) -> None:
        self.now = None if fresh else self.run.get()
        self.chains = {} if fresh else {k[0]: tuple(v) for k, v in self.unanswered.iterator()}
        self.before = self.now, dict(self.chains)

    def save(self) -> None:
        run, chains = self.before
        if self.now != run:
            self.run.update(self.now) if self.now else self.run.clear()
        for name in chains.keys() - self.chains.keys():
            self.unanswered.removeKey((name,))
        for name, chain in self.chains.items():
            if chains.get(name) != chain:
                self.unanswered.updateValue((name,), chain)

    def step(self, id, tool, failed) -> list[tuple]:
        out, name = [], _NONE if tool is None else tool
        run = self.now
        if run and run[0] == name and failed:
            self.now = (name, run[1] + 1, run[2], id)
            return out
        if run:
            self.now = None
            self.chains[run[0]] = tuple(run[1:])
        if name in self.chains:
            out.append((tool, *self.chains.pop(name), id, "failed" if failed else "passed"))
        if failed:
            self.now = (name, 1, id, id)
        return out

    def finish(self) -> list[tuple]:
        open_chains = [(name, *chain) for name, chain in self.chains.items()]
        if self.now:
            open_chains.append(self.now)
        self.now, self.chains = None, {}
        return [(None if tool == _NONE else tool, *chain, None, "none") for tool, *chain in open_chains]


class Boundaries(Ordered):
    """Adjacent compaction records, until a record intervenes that breaks or a kind comes again."""

    columns = ["at", "id", "kind", "breaks"]
    pending = "at long, id long, kind string, breaks boolean"
    names = [c.split()[0] for c in BOUNDARY.split(", ")]

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "next long")
        self.current = handle.getValueState("current", "records long, first long, last long, kinds string")

    def load(self, fresh: bool) -> None:
        self.number, self.now = (0, None) if fresh else ((self.count.get() or (0,))[0], self.current.get())
        self.before = self.number, self.now

    def save(self) -> None:
        number, now = self.before
        if self.number != number:
            self.count.update((self.number,)) if self.number else self.count.clear()
        if self.now != now:
            self.current.update(self.now) if self.now else self.current.clear()

    def _end(self) -> list[tuple]:
        if not self.now:
            return []
        records, first, last, kinds = self.now
        self.now, self.number = None, self.number + 1
        return [(self.number - 1, records, first, last, sorted(kinds.split("\n")))]

    def step(self, id, kind, breaks) -> list[tuple]:
        if kind is None:
            return self._end() if breaks else []
        kind = kind.replace("\n", " ")
        records, first, _, kinds = self.now or (0, id, id, "")
        out = []
        if records and kind in kinds.split("\n"):
            out, records, first, kinds = self._end(), 0, id, ""
        self.now = (records + 1, first, id, f"{kinds}\n{kind}" if records else kind)
        return out

    def finish(self) -> list[tuple]:
        out = self._end()
        self.number = 0
        return out


def timed(records: DataFrame, at: str, delay: str) -> DataFrame:
    """Records with a time, and the watermark that says how late they may be; ``at`` is in microseconds beside it."""
    return records.where(F.col(at).isNotNull()).withColumn("event_time", F.col(at).cast("timestamp")).withColumn("at", F.unix_micros("event_time")).withWatermark("event_time", delay)


def _folded(records: DataFrame, scope: str, processor: Ordered, shape: str) -> DataFrame:
    # Spark asks the processor for its state in a Python process of the driver that gets no files of the application
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    own = [F.coalesce("id", F.lit(-(2**63))).alias("id") if c == "id" else F.col(c) for c in processor.columns]
    rows = records.select(F.coalesce(F.col(scope).cast("string"), F.lit("")).alias("scope"), "event_time", *own)
    return rows.groupBy("scope").transformWithStateInPandas(processor, shape, "append", "eventTime")


def failure_chains(operations: DataFrame, scope: str, idle_ms: int) -> DataFrame:
    """operations: what ``timed`` gives, with id, tool, failed. A row for each chain, once it has ended."""
    return _folded(operations, scope, FailureChains(idle_ms), CHAIN)


def compaction_boundaries(records: DataFrame, scope: str, idle_ms: int) -> DataFrame:
    """records: what ``timed`` gives, with id, kind (null unless a compaction record) and breaks. A row for each boundary that has ended."""
    return _folded(records, scope, Boundaries(idle_ms), BOUNDARY)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[SparkSession]:
    """A session whose streams keep their state in RocksDB, which timers and list state need."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    yield own
