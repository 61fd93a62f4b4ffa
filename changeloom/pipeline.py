"""Snapshot, then log: the parts of the library put together for one source and one sink."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions.positions import resume
from .operators.delivery import batched, measured
from .operators.envelope import envelopes, snapshot_envelopes
from .operators.filters import without_boundaries
from .operators.history import schema_history
from .operators.transactions import CAP
from .schemas import SCHEMA_HISTORY
from .sinks import Sink, create
from .sources.shared import shared_folder
from .sources.snapshot import Snapshot
from .sources.stores import OffsetStore, load_history, save_history
from .streaming.run import deliver


@dataclass
class Pipeline:
    """Runs what is new: with no offset a snapshot first, then the log from its position on.

    Events carry their ``delivery_batch``: whole transactions (cut at the cap), loose events by ``batch_size``, and chunks of the snapshot.

    Each run delivers, then acknowledges; a run that fails is repeated from the last
    acknowledged position (whose own record is delivered again).
    """

    spark: SparkSession
    settings: Settings
    sink: Sink | None = None

    def __post_init__(self):
        self.sink = self.sink or create(self.settings.sink)
        self.offsets = OffsetStore(self.settings.offset_path, self.settings.offset_flush_ms)
        self.runs = 0
        # executors write here, so it has to be a folder that they share
        self.staging = self.settings.staging_path or shared_folder(self.spark, "cdc_staging")

    def history(self, log: DataFrame, snapshot: Snapshot | None) -> DataFrame:
        """The stored history with the snapshot's tables and the log's statements."""
        stored = load_history(self.spark, self.settings.schema_path)
        if snapshot is not None and self.offsets.committed is None:
            stored = stored.unionByName(snapshot.history(self.spark, self.settings.tables))
        known = stored.select("database", "table", "binlog_file", "position", "ddl").where("ddl is not null")
        new = log.where("kind = 'schema'").join(known, ["database", "table", "binlog_file", "position", "ddl"], "left_anti")
        placed = stored.withColumn("ddl", F.lit(None).cast("string"))  # entries are results already
        folded = schema_history(placed, new)
        return folded.join(known.withColumnRenamed("ddl", "_ddl"), ["database", "table", "binlog_file", "position"], "left").withColumn("ddl", F.coalesce("ddl", "_ddl")).select(*SCHEMA_HISTORY.names)

    def events(self, log: DataFrame, history: DataFrame) -> DataFrame:
        own = self.settings.tables.apply(log)
        return envelopes(own if self.settings.transaction_boundaries else without_boundaries(own), history)

    def run(self, log: DataFrame, snapshot: Snapshot | None = None) -> int:
        """Delivers the snapshot if there is no offset yet, and the log's records after the offset; the number of events."""
        history = self.history(log, snapshot)
        total = 0
        if self.offsets.committed is None and snapshot is not None and self.settings.snapshot_enabled:
            self.offsets.begin_snapshot()
            rows = snapshot_envelopes(snapshot.rows(self.spark, self.settings.tables), snapshot.binlog_file, snapshot.position)
            # chunks by the key's hash: rows of a snapshot have no order
            # counted by table first (a row for each table), so that no table is shuffled to one task
            chunks = F.greatest(F.lit(1).cast("long"), F.ceil(F.count("*") / self.settings.snapshot_chunk_size)).alias("chunks")
            sized = rows.groupBy("database", "table").agg(chunks).withColumnsRenamed({"database": "_database", "table": "_table"})
            # a row for each table: Spark broadcasts them if they are few
            rows = rows.join(sized, F.col("database").eqNullSafe(F.col("_database")) & F.col("table").eqNullSafe(F.col("_table")))
            chunk = F.pmod(F.xxhash64("idempotency_key"), F.col("chunks"))
            rows = rows.withColumn("delivery_batch", F.concat_ws("-", F.lit("snapshot"), "database", "table", chunk)).withColumn("pending", F.lit(False))
            total += self._deliver(rows.drop("_database", "_table", "chunks"))[0]
            self.offsets.end_snapshot(snapshot.binlog_file, snapshot.position)
        save_history(history, self.settings.schema_path)
        own = resume(log, self.offsets.committed)
        events = self.events(own, load_history(self.spark, self.settings.schema_path))
        n, top = self._deliver(batched(events, CAP, self.settings.batch_size, leads=True))
        if top is not None:
            self.offsets.ack(*top)
            self.offsets.flush()
        return total + n

    def _deliver(self, events: DataFrame) -> tuple[int, tuple[str, int] | None]:
        """Delivers what has a batch; the number of events, and the position up to which nothing is pending.

        Events are written durably first, so that their ids stay the same whatever is lost or delivered again; the pass that writes them counts them.
        """
        staged = f"{self.staging}/run-{uuid.uuid4().hex}"
        marked, seen = measured(events if "leads" in events.columns else events.withColumn("leads", F.lit(False)))
        marked.write.parquet(staged)
        seen, events = seen.get, self.spark.read.parquet(staged)
        n, top, still = seen["events_delivered"], seen["top"], seen["open"]
        if n:
            deliver(self.sink, events.where(~F.col("pending")).drop("pending"), self.runs, attempts=5)
            self.runs += 1
        # a transaction that is still open is read again from its begin
        last = min((x for x in (top, still) if x is not None), default=None, key=tuple) if still is not None else top
        return n, None if last is None or not n else (last["binlog_file"], last["position"])
