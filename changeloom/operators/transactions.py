"""Transactions as groups: counts, complete batches, pending ones, orphans, the size cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAP = 10_000
HEAVY = 50_000  # transactions that are cut first, at most
RANGE = 1 << 20  # bytes of the log that are counted together


def marks(log: DataFrame, tx: str = "transaction_id") -> DataFrame:
    """Per transaction: rows, events, and whether it has begun and committed. One shuffle, combined first."""
    has = lambda kind: F.max(F.col("kind") == kind)
    return log.where(F.col(tx).isNotNull()).groupBy(tx).agg(F.count_if(F.col("kind") == "row").alias("row_count"), F.count("*").alias("events"), has("tx_begin").alias("begun"), has("tx_commit").alias("committed"))


def complete(log: DataFrame, tx: str = "transaction_id") -> DataFrame:
    return marks(log, tx).where("begun and committed")


def pending(log: DataFrame, tx: str = "transaction_id") -> DataFrame:
    """Transactions that have begun and not committed; they are never expired."""
    return marks(log, tx).where("begun and not committed")


def orphans(log: DataFrame, tx: str = "transaction_id") -> DataFrame:
    """Events whose transaction never began here, or that have none: they are delivered by themselves."""
    begun = log.where("kind = 'tx_begin'").select(tx).distinct()
    return log.join(begun, tx, "left_anti")


def _far(log: DataFrame, tx: str, most: int, file: str = "binlog_file", offset: str = "position") -> DataFrame:
    """Adds ``_far``: true for what is surely beyond the first ``most`` rows of its transaction in log order.

    Rows of a transaction are counted by ranges of the log, combined before the shuffle; only rows of ranges that begin before
    ``most`` rows are through need to be sorted. So of a transaction of any size, a task sorts ``most`` rows and a range of the log.
    """
    place = F.struct(F.coalesce(file, F.lit("")).alias("f"), F.floor(F.coalesce(offset, F.lit(0)) / RANGE).alias("b"))
    counts = log.groupBy(tx, place.alias("_place")).agg(F.count("*").alias("_rows"))
    by_tx = Window.partitionBy(tx)
    through = F.sum("_rows").over(by_tx.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    heavy = counts.select(tx, "_place", F.sum("_rows").over(by_tx).alias("_all"), through.alias("_before")).where((F.col("_all") > 8 * most) & (F.coalesce("_before", F.lit(0)) < most))
    ends = heavy.groupBy(tx).agg(F.max("_place").alias("_end"), F.max("_all").alias("_all"))
    # those that are left out are sorted whole; they have fewer rows than all that are cut
    ends = ends.orderBy(F.desc("_all")).limit(HEAVY).select(F.col(tx).alias("_tx"), "_end")
    return log.join(F.broadcast(ends), F.col(tx) == F.col("_tx"), "left").withColumn("_far", F.coalesce(place > F.col("_end"), F.lit(False))).drop("_tx", "_end")


def assemble(log: DataFrame, tx: str = "transaction_id", cap: int = CAP, order: tuple[str, ...] = ("binlog_file", "position", "delivery_seq")) -> DataFrame:
    """One row per delivered batch: the transaction, its events in order, and whether the cap cut it.

    After a begin, events gather until the commit, or until there are more than ``cap``;
    then what has gathered is delivered (``cap`` + 1 events), and the rest is orphaned. A
    begin that is repeated starts anew. Arrays are bounded by the cap, and what a task sorts of
    one transaction by the cap and a range of the log. ``order`` begins with the file and the position.
    """
    begins = log.where(F.col("kind") == "tx_begin").groupBy(tx).agg(F.max(F.struct(*order)).alias("_begin"))
    seen = log.where(F.col(tx).isNotNull()).join(begins, tx).where(F.struct(*order) >= F.col("_begin")).drop("_begin")
    kept = _far(seen, tx, cap + 1, *order[:2]).where(~F.col("_far")).drop("_far").withColumn("_n", F.row_number().over(Window.partitionBy(tx).orderBy(*order)))
    kept = kept.withColumn("_closed", F.min(F.when(F.col("kind") == "tx_commit", F.col("_n"))).over(Window.partitionBy(tx)))
    kept = kept.where((F.col("_n") <= cap + 1) & (F.col("_closed").isNull() | (F.col("_n") <= F.col("_closed"))))
    out = kept.groupBy(tx).agg(F.array_sort(F.collect_list(F.struct("_n", *[F.col(c) for c in log.columns if c != tx]))).alias("events"), F.count("*").alias("n"), F.max(F.col("kind") == "tx_commit").alias("committed"), F.max(F.struct("binlog_file", "position")).alias("max_position"))
    return out.where(F.col("committed") | (F.col("n") > cap)).withColumn("cut", ~F.col("committed")).drop("committed")


def capped(log: DataFrame, tx: str = "transaction_id", cap: int = CAP) -> DataFrame:
    """Per transaction that overflows or just fills the cap: events delivered as a part, and orphaned ones. Counts alone, combined first."""
    counts = log.where(F.col(tx).isNotNull()).groupBy(tx).agg(F.count("*").alias("n"), F.max(F.col("kind") == "tx_begin").alias("begun"))
    return counts.where(F.col("begun") & (F.col("n") > cap)).select(tx, F.least(F.col("n"), F.lit(cap + 1).cast("long")).alias("partial_events"), F.greatest(F.col("n") - cap - 1, F.lit(0).cast("long")).alias("orphan_events"))
