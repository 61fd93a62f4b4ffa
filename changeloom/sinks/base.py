"""The contract of sinks, a table of deliveries, and one for looking at."""

from __future__ import annotations

import sys
from abc import ABC, abstractmethod
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import views
from ..operators.envelope import to_json
from ..sources.shared import shared_folder


class Sink(ABC):
    """``deliver`` returns when the batch is durable and raises to have it delivered again."""

    @abstractmethod
    def deliver(self, events: DataFrame, batch_id: int) -> None: ...


class TableSink(Sink):
    """Accumulates deliveries as a table in a shared folder, a folder per batch; one that is delivered again replaces itself.

    ``events`` has them all, with ``delivery_seq``, (batch, row), unless they bring one; unique events, repeats and the latest
    per key are views of it.
    """

    def __init__(self, path: str | None = None):
        self.path, self.spark = path, None

    def deliver(self, events: DataFrame, batch_id: int) -> None:
        self.spark = events.sparkSession
        self.path = self.path or shared_folder(self.spark, "deliveries")
        events.withColumn("_row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{self.path}/_batch={batch_id}")

    def events(self, spark: SparkSession | None = None) -> DataFrame:
        found = (spark or self.spark).read.parquet(self.path)
        place = F.struct(F.col("_batch").cast("long").alias("batch"), F.col("_row").alias("row"))
        return (found if "delivery_seq" in found.columns else found.withColumn("delivery_seq", place)).drop("_batch", "_row")

    def unique_events(self, order: str = "delivery_seq") -> DataFrame:
        return views.unique_events(self.events(), order=order)

    def duplicates(self, order: str = "delivery_seq") -> DataFrame:
        return views.duplicates(self.events(), order=order)

    def latest(self, columns: list[str], at: Column, order: str = "delivery_seq") -> DataFrame:
        """The event at the greatest position of each key; of equal ones that delivered first."""
        first = views.unique_events(self.events(), order=order).where("dedup_key is not null")
        return first.groupBy("dedup_key").agg(F.max_by(F.struct(*columns), F.struct(at.alias("at"), F.col("idempotency_key"))).alias("_x")).select("dedup_key", "_x.*")


class MemorySink(TableSink):
    """The sink of this name of a single process: here its deliveries are a table, too."""


def _log_lines(batch_id: int):
    def write(rows: Iterator) -> None:
        for r in rows:
            sys.stderr.write(f"batch {batch_id}: {r.value}\n")
        sys.stderr.flush()

    return write


class LogSink(Sink):
    """One line per event, in the logs of the executors that hold them; nothing passes through the driver.

    ``to_stdout`` is for looking at: its lines are the driver's own output, which the driver must see, in order, a partition at a time.
    """

    def __init__(self, to_stdout: bool = False):
        self.to_stdout = to_stdout

    def deliver(self, events: DataFrame, batch_id: int) -> None:
        lines = to_json(events)
        if not self.to_stdout:
            lines.foreachPartition(_log_lines(batch_id))
            return
        for r in lines.toLocalIterator():
            sys.stdout.write(r.value + "\n")
