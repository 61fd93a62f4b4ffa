"""Transactions and unique events over an unbounded log."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.transactions import CAP

BATCH = "transaction_id string, kind string, n_events int, row_count int, max_file string, max_position long, cut boolean, events array<string>"
_BATCH = Row(*[f.split()[0] for f in BATCH.split(", ")])
LANES = 1024  # fixed, as the state is kept by lane
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Assembler(StatefulProcessor):
    """Keeps a transaction's events from its begin; delivers at the commit or beyond the cap.

    The key is a lane, a part of all transactions, as a call for each small transaction costs far more than its events. A transaction's
    events are added to the state by micro-batch, with a count beside them, and are read only when it is delivered: a micro-batch costs what it brings. One
    that begins and ends within a micro-batch asks the state once and writes nothing.
    """

    def __init__(self, cap: int = CAP):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.opened = handle.getMapState("opened", "tx string", "n int, parts int")
        self.events = handle.getMapState("events", "tx string, part int", "lines array<struct<kind:string,file:string,position:bigint,event:string>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        by_tx: dict[str, list[tuple]] = {}  # a lane's rows of one micro-batch; the source's rate bounds them
        for r in rows:
            by_tx.setdefault(r.transaction_id, []).append((r.kind, r.binlog_file, r.position, r.event))
        for tx, lines in by_tx.items():
            yield from self._assembled(tx, sorted(lines, key=_place))

    def _assembled(self, tx: str, lines: list[tuple]) -> Iterator[Row]:
        """What is delivered of a transaction with a micro-batch's events, in log order."""
        n, parts = before = self.opened.getValue((tx,)) or (None, 0)
        fresh: list[tuple] = []  # at most cap + 1 events that aren't in the state yet
        for line in lines:
            kind = line[0]
            if kind != "tx_begin" and n is None:
                yield self._batch(tx, [line], "orphan")
                continue
            if kind == "tx_begin":  # one that is repeated starts anew
                parts = self._forget(tx, parts)
                fresh, n = [line], 1
                continue
            fresh.append(line)
            n += 1
            if kind == "tx_commit" or n > self.cap:
                kept = [tuple(x) for part in range(parts) for x in self.events.getValue((tx, part))[0]] + fresh
                yield self._batch(tx, kept, "transaction" if kind == "tx_commit" else "part")
                parts = self._forget(tx, parts)
                fresh, n = [], None
        if fresh:
            self.events.updateValue((tx, parts), (fresh,))
            parts += 1
        if n is None and before[0] is not None:
            self.opened.removeKey((tx,))
        elif n is not None and (n, parts) != tuple(before):
            self.opened.updateValue((tx,), (n, parts))

    def _forget(self, tx: str, parts: int) -> int:
        for part in range(parts):
            self.events.removeKey((tx, part))
        return 0

    def _batch(self, tx: str, lines: list[tuple], kind: str) -> Row:
        _, file, position, _ = max(lines, key=_place)
        return _BATCH(tx, kind, len(lines), sum(k == "row" for k, *_ in lines), file, position, kind == "part", [e for *_, e in lines])

    def close(self) -> None:
        pass


def _place(line: tuple) -> tuple[str, int]:
    return line[1] or "", line[2] or 0


def assembled(events: DataFrame, cap: int = CAP) -> DataFrame:
    """A row per delivered transaction, part of one beyond the cap, or orphan; ``events`` in log order, as JSON.

    State is kept by lane and transaction (use the RocksDB provider), so it is open transactions only. Loose events,
    without a transaction, pass at once, a row each (``kind`` loose), and are batched by the micro-batch. Order between transactions is that of ``max_file`` and ``max_position``.
    """
    every = events.select("transaction_id", "kind", "binlog_file", "position", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("event"))
    own = every.where("transaction_id is not null")
    loose = every.where("transaction_id is null").select("transaction_id", F.lit("loose").alias("kind"), F.lit(1).alias("n_events"), (F.col("kind") == "row").cast("int").alias("row_count"), F.col("binlog_file").alias("max_file"), F.col("position").alias("max_position"), F.lit(False).alias("cut"), F.array("event").alias("events"))
    lane = F.pmod(F.xxhash64("transaction_id"), F.lit(LANES)).alias("lane")
    whole = own.select(lane, "*").groupBy("lane").transformWithState(_Assembler(cap), BATCH, "Append", "None")
    return whole.unionByName(loose)


def unique(events: DataFrame, key: str = "idempotency_key", within: str | None = None, ts: str = "event_time") -> DataFrame:
    """Events whose key was not seen before. State grows with the keys; ``within`` bounds it by a watermark on ``ts``."""
    if within:
        return events.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])
