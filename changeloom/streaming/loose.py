"""Events without a transaction as batches: flushed by size, or by the age of the oldest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BATCH = "lane long, batch_no long, n_events int, first_seq long, last_seq long, reason string, events array<string>"


class _Buffer(StatefulProcessor):
    """A lane's waiting events, in the order in which they came, and the time of the first.

    New events are appended to a list state and a count is kept beside it, so a micro-batch touches what it brings and what it
    delivers, and not what waits. A timer at the oldest event's time plus the interval flushes what no later event flushes.
    """

    def __init__(self, size: int, age_ms: int, event_time: bool):
        self.size, self.age_ms, self.event_time = size, age_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq long, event string")
        self.about = handle.getValueState("about", "n int, oldest long, batch_no long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, oldest, number = self.about.get() if self.about.exists() else (0, 0, 0)
        timer = oldest if n else None  # the one that is set
        fresh: list[tuple[int, str]] = []
        out = []
        frame = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")  # a lane's rows of one micro-batch, which the source's rate bounds
        for r in frame.itertuples():
            at = int(r.at) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            if n and at - oldest >= self.age_ms:
                out.append(self._flushed(key[0], number, fresh, "age"))
                fresh, n, number = [], 0, number + 1
            fresh.append((int(r.seq), r.event))
            oldest, n = (at if n == 0 else oldest), n + 1
            if n >= self.size:
                out.append(self._flushed(key[0], number, fresh, "size"))
                fresh, n, number = [], 0, number + 1
        if fresh:
            self.waiting.appendList(fresh)
        if timer is not None and (n == 0 or oldest != timer):
            self.handle.deleteTimer(timer + self.age_ms)
        if n and oldest != timer:
            self.handle.registerTimer(oldest + self.age_ms)
        self.about.update((n, oldest, number))
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in BATCH.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, oldest, number = self.about.get() if self.about.exists() else (0, 0, 0)
        if n:
            yield pd.DataFrame([self._flushed(key[0], number, [], "age")], columns=[f.split()[0] for f in BATCH.split(", ")])
            self.about.update((0, oldest, number + 1))

    def _flushed(self, lane: int, number: int, fresh: list[tuple[int, str]], reason: str) -> tuple:
        events = [(int(r[0]), r[1]) for r in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        events += fresh
        return lane, number, len(events), events[0][0], events[-1][0], reason, [e for _, e in events]

    def close(self) -> None:
        pass


def loose_batches(events: DataFrame, lane: str, seq: str, at: str | None = None, size: int = 100, age_ms: int = 500, lateness: str = "0 seconds") -> DataFrame:
    """A row per batch of loose events, for each lane: flushed whole with its ``size``-th event, or when the oldest is ``age_ms`` old.

    With ``at``, a timestamp column, age is event time: batches are the same however the stream is cut into micro-batches, and a
    lane's last one waits until the watermark passes it. Without, age is processing time. One buffer for all would be
    one task: lanes are buffered apart (a column of few values, such as a hash of the table). Needs the RocksDB provider.
    """
    own = events.withWatermark(at, lateness) if at else events
    ms = F.unix_millis(F.col(at)) if at else F.lit(0).cast("long")
    names = [c for c in events.columns]
    line = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    picked = own.select(F.col(lane).cast("long").alias("lane"), F.col(seq).cast("long").alias("seq"), ms.alias("at"), line.alias("event"), *([F.col(at).alias("event_time")] if at else []))
    return picked.groupBy("lane").transformWithStateInPandas(_Buffer(size, age_ms, at is not None), BATCH, "Append", "EventTime" if at else "ProcessingTime")
