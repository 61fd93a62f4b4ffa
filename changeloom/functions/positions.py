"""Log positions: (file, offset), ordered as a pair; files compare as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position(file: str = "binlog_file", offset: str = "position") -> Column:
    return F.struct(F.col(file).alias("binlog_file"), F.col(offset).alias("position"))


def at_or_after(file: str, offset: int) -> Column:
    """Resume predicate, written out so that it is pushed to the scan (a comparison of structs isn't)."""
    return (F.col("binlog_file") > file) | ((F.col("binlog_file") == file) & (F.col("position") >= offset))


def resume(log: DataFrame, committed: tuple[str, int] | None) -> DataFrame:
    """The log from a committed position on, which is delivered again; all of it without one."""
    return log if committed is None else log.where(at_or_after(*committed))


def highest() -> Column:
    """Aggregate: the greatest position among rows with a file (a missing offset counts as 0)."""
    return F.max(F.when(F.col("binlog_file").isNotNull(), F.struct("binlog_file", F.coalesce("position", F.lit(0)).alias("position"))))


def committed_so_far(deliveries: DataFrame, value: Column, order: str = "delivery_seq", bucket_rows: int = 1_000_000) -> DataFrame:
    """Adds ``committed``: the running maximum of ``value`` in delivery order.

    A window over everything would be one task. Rows are dealt to ranges of the order
    column instead; each range's running maximum starts from the maximum of the ranges before, which
    is a window over one row per range.
    """
    dealt = deliveries.withColumn("_value", value).withColumn("_bucket", F.floor(F.col(order) / bucket_rows))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_bucket").agg(F.max("_value").alias("_top")).select("_bucket", F.max("_top").over(upto).alias("_before"))
    own = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(before, "_bucket").withColumn("committed", F.greatest("_before", F.max("_value").over(own))).drop("_value", "_bucket", "_before")
