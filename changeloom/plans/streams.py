"""Registered queries that run as streams: the log is landed in parts, each taken by a run that resumes from the one before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.published import NAME as PUBLISHED
from ..sinks.published import PublishedFiles, PublishedSink
from ..sources.logstream import land, stream_positions
from ..sources.shared import register, shared_folder
from ..streaming.assemble import ROCKSDB, assembled, unique
from ..streaming.loose import loose_batches
from ..streaming.table import KeyedTable
from . import changelog as c

PARTS = 3


def _session(spark: SparkSession) -> SparkSession:
    """A session beside the given one with the state store that the processors need."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    return own


def _ranges(log: DataFrame, order: str, parts: int = PARTS) -> Iterator[DataFrame]:
    """The log in ``parts`` ranges of ``order``, one after another."""
    low, high = log.agg(F.min(order), F.max(order)).first()
    for i in range(parts):
        if low is None:
            yield log
            return
        at = lambda k: low + (high - low) * k / parts
        yield log.where((F.col(order) >= at(i)) & ((F.col(order) < at(i + 1)) if i + 1 < parts else F.lit(True)))


def _in_parts(log: DataFrame, order: str, path: str, parts: int = PARTS) -> Iterator[None]:
    """Lands the log in ranges; yields after each."""
    for part in _ranges(log, order, parts):
        part.write.mode("append").parquet(path)
        yield


def _streamed(spark: SparkSession, log: DataFrame, order: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream has delivered after all parts, each of which a new run took from the checkpoint on."""
    own, folder = _session(spark), shared_folder(spark, "stream")
    schema = None
    for _ in _in_parts(log, order, f"{folder}/log"):
        made = build(own.readStream.schema(log.schema).parquet(f"{folder}/log"))
        schema = made.schema
        made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


def stream_loose_batches(s: SparkSession, d: str) -> DataFrame:
    """Rows in sixteen lanes, flushed with sixteen events or four hours after the oldest; what still waits at the end isn't delivered."""
    rows = s.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("user_id") % 16).alias("lane"))
    found = _streamed(s, rows, "ts", lambda log: loose_batches(log, "lane", "event_id", "ts", 16, 4 * 3_600_000))
    return found.select("lane", "batch_no", "n_events", "first_seq", "last_seq", "reason")


def stream_tx_assembly(s: SparkSession, d: str) -> DataFrame:
    """``tx_assembly`` as a stream, cut amid transactions."""
    log = c.log(s, d).select(F.col("tx").cast("string").alias("transaction_id"), "kind", "binlog_file", "position", "slot")
    found = _streamed(s, log, "slot", lambda log: assembled(log, cap=4)).where("kind in ('transaction', 'part')")
    events = F.transform("events", lambda e: F.from_json(e, "kind string, slot long"))
    text = lambda field: F.array_join(F.transform(events, lambda e: e[field].cast("string")), ",")
    return found.select(F.col("transaction_id").cast("long").alias("tx"), text("kind").alias("kinds"), text("slot").alias("slots"), F.col("n_events").cast("long").alias("n"), "cut", "max_file", F.col("max_position").alias("max_pos"))


def stream_unique_events(s: SparkSession, d: str) -> DataFrame:
    """Each key once, whatever the number of its deliveries."""
    return _streamed(s, c.delivered(s, d).select("idempotency_key", "delivery_seq"), "delivery_seq", lambda log: unique(log)).select("idempotency_key")


def stream_materialized_view(s: SparkSession, d: str) -> DataFrame:
    """``materialized_view`` kept by micro-batches in a keyed table, compacted on the way."""
    own, folder = _session(s), shared_folder(s, "stream")
    log = c.events(s, d).where("kind = 'row'").select("tbl", "user_id", "event_type", "value", "op", "binlog_file", "position", "slot")
    table = KeyedTable(s, f"{folder}/table", log.schema, ["tbl", "user_id"], ["binlog_file", "position"])
    for _ in _in_parts(log, "slot", f"{folder}/log", 4):
        stream = own.readStream.schema(log.schema).parquet(f"{folder}/log")
        stream.writeStream.foreachBatch(lambda rows, batch: table.upsert(rows, batch)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        table.compact(2)
    return table.read().select("user_id", "event_type", "value")


def stream_resume_from(s: SparkSession, d: str) -> DataFrame:
    """The log from a position on, inclusively, as a stream of positions into published files; it is landed in parts, each a run of its own."""
    folder = shared_folder(s, "stream")
    log = c.log(s, d).select("slot", "kind", "position", "binlog_file")
    sink = PublishedSink(f"{folder}/out")
    register(s, PublishedFiles)
    for part in _ranges(log, "slot", PARTS):
        land(part, f"{folder}/log")
        stream = stream_positions(s, f"{folder}/log", log.schema, (f"{c.FILE}000002", 4 + 128 * 300), 1_000_000, f"{folder}/progress.json")
        query = stream.writeStream.format(PUBLISHED).option("path", sink.path).option("checkpointLocation", f"{folder}/checkpoint").start()
        query.processAllAvailable()
        query.stop()
    return sink.events(s, log.schema)


QUERIES = {f.__name__: f for f in (stream_loose_batches, stream_tx_assembly, stream_unique_events, stream_materialized_view, stream_resume_from)}
