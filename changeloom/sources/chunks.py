"""A snapshot without one position for all: a table is read chunk by chunk while its log goes on."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import Ledger

Mark = tuple[str, int]


def between(low: Mark, high: Mark):
    """After ``low``, up to and with ``high``; written out, so that scans take it."""
    after = (F.col("binlog_file") > low[0]) | ((F.col("binlog_file") == low[0]) & (F.col("position") > low[1]))
    upto = (F.col("binlog_file") < high[0]) | ((F.col("binlog_file") == high[0]) & (F.col("position") <= high[1]))
    return after & upto


def settled(rows: DataFrame, log: DataFrame, key: list[str], low: Mark, high: Mark) -> DataFrame:
    """A chunk's rows as they are at ``high``: those that the log touched between the marks give way to it.

    A row was read at some position between the marks, it isn't known which. What the log didn't touch there is the same at ``high``; what it
    touched comes from the log, which is delivered from the first chunk's low mark on.
    """
    touched = log.where((F.col("kind") == "row") & between(low, high)).select(*key).distinct()
    return rows.join(touched, key, "left_anti").withColumns({"binlog_file": F.lit(high[0]), "position": F.lit(high[1]).cast("long")})


class ChunkedSnapshot:
    """Reads ``chunks`` parts of a table, each between two marks of the log, and keeps them below ``path`` (a shared folder).

    A chunk counts once its marks are in the ledger, after its rows are written. A run that ends half-way is resumed with the first
    chunk that isn't there; rows of one that was cut off are written anew.
    """

    def __init__(self, spark: SparkSession, path: str, chunks: int, key: list[str]):
        self.spark, self.path, self.chunks, self.key = spark, path, chunks, key
        self.ledger = Ledger(spark, f"{path}/ledger")

    def run(self, read: Callable[[int], DataFrame], log: Callable[[], DataFrame], mark: Callable[[], Mark], most: int | None = None) -> list[int]:
        """Takes the chunks that are left (``most`` of them): ``read`` gives a chunk's rows, ``mark`` the log's end, ``log`` the log. The chunks taken."""
        left = [i for i in range(self.chunks) if i not in self.ledger.entries()][:most]
        for i in left:
            low = mark()
            read(i).write.mode("overwrite").parquet(f"{self.path}/read/chunk={i}")  # it must not be read again after the mark
            high = mark()
            rows = self.spark.read.parquet(f"{self.path}/read/chunk={i}")
            settled(rows, log(), self.key, low, high).write.mode("overwrite").parquet(f"{self.path}/rows/chunk={i}")
            self.ledger.add(i, json.dumps({"low": low, "high": high}))
        return left

    def rows(self) -> DataFrame:
        """The rows of all chunks, each at its high mark."""
        return self.spark.read.parquet(*[f"{self.path}/rows/chunk={i}" for i in sorted(self.ledger.entries())])

    def start(self) -> Mark:
        """Where the log is to be delivered from, after: the least low mark."""
        return min(tuple(json.loads(text)["low"]) for text in self.ledger.entries().values())
