"""Views over deliveries: unique events, repeats, the latest per key, the table itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rank(deliveries: DataFrame, key: str, order: str) -> DataFrame:
    return deliveries.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def unique_events(deliveries: DataFrame, key: str = "idempotency_key", order: str = "delivery_seq") -> DataFrame:
    """The first delivery of each key; events without a key all stay.

    Without the whole row a grouped minimum would do; with it, the window keeps the rows' columns in one shuffle.
    """
    keyed = F.coalesce(F.col(key), F.lit("")) != ""
    first = _rank(deliveries.where(keyed), key, order).where("_n = 1").drop("_n")
    return first.unionByName(deliveries.where(~keyed))


def duplicates(deliveries: DataFrame, key: str = "idempotency_key", order: str = "delivery_seq") -> DataFrame:
    return _rank(deliveries.where(F.coalesce(F.col(key), F.lit("")) != ""), key, order).where("_n > 1").drop("_n")


def latest(events: DataFrame, key: str | list[str], at: Column, seq: str, columns: list[str]) -> DataFrame:
    """The event at the greatest position of each key (ties: the one delivered first); deletes stay.

    A maximum of structs combines before the shuffle, so a hot key costs one row per task.
    """
    keys = [key] if isinstance(key, str) else key
    best = F.max_by(F.struct(*columns), F.struct(at.alias("at"), (-F.col(seq)).alias("tie"))).alias("best")
    return events.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(best).select(*keys, "best.*")


def materialized(events: DataFrame, key: str | list[str], at: Column, seq: str, columns: list[str], operation: str = "op") -> DataFrame:
    """The table that replaying the events leaves: the latest of each key unless it is a delete."""
    wanted = columns if operation in columns else [*columns, operation]
    out = latest(events, key, at, seq, wanted).where(F.coalesce(F.col(operation), F.lit("")) != "DELETE")
    return out if operation in columns else out.drop(operation)


def unseen(events: DataFrame, seen: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """Events whose key a sink has not persisted. Repeats inside of a batch all pass."""
    return events.join(seen.select(key).distinct(), key, "left_anti")
