"""Log records and snapshot rows as events: named images, keys, one shape for all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import dedup_key, idempotency_key, key_text
from ..schemas import IMAGE
from .asof import schema_at


def named(image: Column, columns: Column) -> Column:
    """(name, value, data_type) of a positional image: by the schema if the widths agree, else col_0, col_1 …"""
    known = F.zip_with(image, columns, lambda v, c: F.struct(c["name"].alias("name"), v.alias("value"), c["data_type"].alias("data_type")))
    unknown = F.transform(image, lambda v, i: F.struct(F.concat(F.lit("col_"), i.cast("string")).alias("name"), v.alias("value"), F.lit(None).cast("string").alias("data_type")))
    return F.when(image.isNull(), F.array().cast(IMAGE)).when(F.size(image) == F.size(columns), known).otherwise(unknown)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often the body uses it (also inside lambdas, where it would be made for each element)."""
    return F.transform(F.array(value), body)[0]


def as_map(image: Column) -> Column:
    """name → value of an image; of equal names the last counts."""

    def made(own: Column) -> Column:
        names = F.array_distinct(F.transform(own, lambda c: c["name"]))
        entries = F.transform(own, lambda c: F.struct(c["name"].alias("key"), c["value"].alias("value")))
        # names that are repeated are rare, so only then is each looked for
        last = F.transform(names, lambda n: F.element_at(F.filter(own, lambda c: c["name"] == n), -1)["value"])
        return F.when(F.size(names) == F.size(own), F.map_from_entries(entries)).otherwise(F.map_from_arrays(names, last))

    return bound(image, made)


def primary_key(before: Column, after: Column, key_columns: Column) -> Column:
    """Key columns and their values, from the later image if there is one; a missing column is null."""
    names = F.coalesce(key_columns, F.array().cast("array<string>"))
    return bound(as_map(F.when(F.size(after) > 0, after).otherwise(before)), lambda m: F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(m, k))))


def envelopes(log: DataFrame, history: DataFrame, source: str = "mysql", qualified_keys: bool = False) -> DataFrame:
    """Events of all records: row, tx_begin, tx_commit (with row_count) and schema (with schema_version).

    An operation other than INSERT, UPDATE and DELETE is an error. Row counts are of the
    rows given, so filter tables first.
    """
    commit = F.coalesce(F.col("kind") == "tx_commit", F.lit(False))
    own = schema_at(log.where(~commit), history)
    # only commits meet their transactions' counts: rows, and records without a transaction, aren't shuffled
    counts = log.where("kind = 'row' and transaction_id is not null").groupBy("transaction_id").agg(F.count("*").alias("rows_in_tx"))
    own = own.unionByName(log.where(commit).join(counts, "transaction_id", "left"), allowMissingColumns=True)
    row = F.col("kind") == "row"
    op = F.upper("operation")
    checked = F.when(~row, F.lit(None).cast("string")).when(op.isin("INSERT", "UPDATE", "DELETE"), op).otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce("operation", F.lit("null")))))
    own = own.withColumn("change_type", checked)
    own = own.withColumn("before_columns", F.when(row, named(F.when(F.col("change_type") != "INSERT", F.col("before_row")), F.col("h_columns"))))
    own = own.withColumn("after_columns", F.when(row, named(F.when(F.col("change_type") != "DELETE", F.col("after_row")), F.col("h_columns"))))
    own = own.withColumn("primary_key", F.when(row, primary_key(F.col("before_columns"), F.col("after_columns"), F.col("h_primary_key_columns"))))
    text, kind = key_text(F.col("primary_key")), F.col("kind")
    return own.select(
        F.replace(F.uuid(), F.lit("-")).alias("event_id"),
        kind.alias("event_type"),
        F.lit(source).alias("source"),
        "database",
        F.coalesce("table", F.when(kind == "schema", "")).alias("table"),
        "change_type",
        "before_columns",
        "after_columns",
        "primary_key",
        F.col("ddl").alias("ddl_statement"),
        F.when(kind == "schema", F.coalesce("h_version", F.lit(0))).alias("schema_version"),
        F.when(kind == "tx_commit", F.coalesce("rows_in_tx", F.lit(0))).alias("row_count"),
        "binlog_file",
        "position",
        "gtid",
        F.coalesce("ts", F.lit(0.0)).alias("timestamp"),
        "transaction_id",
        idempotency_key(F.lit(source), F.col("binlog_file"), F.col("position"), kind, text, F.concat_ws(".", "database", "table") if qualified_keys else None).alias("idempotency_key"),
        F.when(row, dedup_key(F.lit(source), F.col("database"), F.col("table"), text)).alias("dedup_key"),
    )


def snapshot_envelopes(rows: DataFrame, file: str, offset: int, source: str = "mysql") -> DataFrame:
    """Events of snapshot rows (database, table, columns, primary_key_columns, row), all at the snapshot's position.

    Images are cut to the shorter of row and columns.
    """
    n = F.least(F.size("row"), F.size("columns"))
    image = F.zip_with(F.slice("row", 1, n), F.slice("columns", 1, n), lambda v, c: F.struct(c["name"].alias("name"), v.alias("value"), c["data_type"].alias("data_type")))
    own = rows.withColumn("after_columns", image).withColumn("primary_key", primary_key(F.array().cast(IMAGE), F.col("after_columns"), F.col("primary_key_columns")))
    text, kind = key_text(F.col("primary_key")), F.lit("snapshot")
    return own.select(
        F.replace(F.uuid(), F.lit("-")).alias("event_id"), kind.alias("event_type"), F.lit(source).alias("source"), "database", "table", F.lit(None).cast("string").alias("change_type"), F.array().cast(IMAGE).alias("before_columns"), "after_columns", "primary_key",
        F.lit(None).cast("string").alias("ddl_statement"), F.lit(None).cast("int").alias("schema_version"), F.lit(None).cast("bigint").alias("row_count"), F.lit(file).alias("binlog_file"), F.lit(offset).cast("bigint").alias("position"), F.lit(None).cast("string").alias("gtid"), F.lit(0.0).alias("timestamp"), F.lit(None).cast("string").alias("transaction_id"),
        idempotency_key(F.lit(source), F.lit(file), F.lit(offset), kind, text).alias("idempotency_key"), dedup_key(F.lit(source), F.col("database"), F.col("table"), text).alias("dedup_key"),
    )


def to_json(events: DataFrame) -> DataFrame:
    """Events as JSON lines (``value``), nulls included."""
    return events.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
