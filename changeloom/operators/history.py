"""The schema history: registered tables and statements folded into versions by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ddl
from ..schemas import SCHEMA_HISTORY

_ENTRY = "binlog_file", "position", "put_seq", "captured_at", "ddl"
_STATE = ddl.STATE


def _prepared(registered: DataFrame, statements: DataFrame) -> DataFrame:
    """Entries of both kinds: where they stand, the state that a registration sets, the parsed script of a statement."""
    nothing = F.lit(None)
    plain = F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["data_type"].alias("data_type"), F.coalesce(c["is_primary_key"], F.lit(False)).alias("is_primary_key"), F.coalesce(c["is_nullable"], F.lit(False)).alias("is_nullable")))
    known = F.struct(F.lit(True).alias("known"), plain.alias("columns"), F.coalesce("primary_key_columns", F.array().cast("array<string>")).alias("primary_key"), F.col("version").alias("version")).cast(_STATE)
    own = F.col("ddl")
    tables = registered.select("database", "table", *_ENTRY, F.when(own.isNull(), F.when(F.col("columns").isNull(), ddl.unknown()).otherwise(known)).alias("set"))
    # entries at equal positions count in the order in which they came: registrations first
    seq = F.lit(1 << 40) + (F.coalesce("put_seq", F.lit(0)) if "put_seq" in statements.columns else F.lit(0))
    log = statements.where(F.coalesce("table", F.lit("")) != "").select("database", "table", "binlog_file", "position", seq.alias("put_seq"), F.col("ts").alias("captured_at"), "ddl", nothing.cast(_STATE).alias("set"))
    return tables.unionByName(log).withColumn("does", ddl.action(F.coalesce(own, F.lit("")))).withColumn("script", F.when(F.col("does").isin(ddl.ALTERS, "create or alter"), ddl.clauses(own)).otherwise(F.array().cast(ddl.CLAUSES)))


def schema_history(registered: DataFrame, statements: DataFrame) -> DataFrame:
    """All versions of all tables. ``registered`` has the history's columns; ``statements`` are the log's schema records.

    Statements are parsed where they are read. The fold is ordered, so a table's entries (control data, some per table) meet in one
    array, and an aggregate over it makes the versions; a registration replaces the latest, a statement changes it.
    """
    entries = _prepared(registered, statements)
    step = F.struct(*_ENTRY[:3], *_ENTRY[3:], "set", "does", "script")
    ordered = entries.groupBy("database", "table").agg(F.array_sort(F.collect_list(step), lambda a, b: _compare(a, b)).alias("steps"))
    start = F.struct(ddl.unknown().alias("now"), F.array().cast(f"array<{_STATE}>").alias("states"))

    def one(seen, step):
        # bound once: the state is used several times below
        new = F.aggregate(F.array(F.coalesce(step["set"], ddl.after(seen["now"], step["does"], step["script"]))), start, lambda _, x: F.struct(x.alias("now"), F.concat(seen["states"], F.array(x)).alias("states")))
        return new

    folded = ordered.withColumn("states", F.aggregate("steps", start, one)["states"])
    each = folded.select("database", "table", F.explode(F.arrays_zip(F.col("steps").alias("step"), F.col("states").alias("state"))).alias("x")).select("database", "table", "x.step", "x.state")
    known = F.col("state.known")
    columns = F.transform("state.columns", lambda c, i: F.struct(c["name"].alias("name"), c["data_type"].alias("data_type"), c["is_primary_key"].alias("is_primary_key"), c["is_nullable"].alias("is_nullable"), *[F.lit(None).cast("string").alias(n) for n in ("default_value", "character_set", "collation", "column_type_extra")], i.alias("ordinal_position")))
    found = each.select("database", "table", *[f"step.{c}" for c in _ENTRY[:3]], F.when(known, columns).alias("columns"), F.when(known, F.col("state.primary_key")).alias("primary_key_columns"), F.when(known, F.col("state.version")).alias("version"), *[f"step.{c}" for c in _ENTRY[3:]])
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA_HISTORY])


def _compare(a, b):
    order = F.lit(0)
    for c in reversed(_ENTRY[:3]):
        order = F.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(order)
    return order


def latest_version(history: DataFrame) -> DataFrame:
    """Per table the version that a statement's event reports: the last known one (0: none)."""
    return history.groupBy("database", "table").agg(F.coalesce(F.max_by("version", F.struct("binlog_file", "position", "put_seq")), F.lit(0)).alias("schema_version"))
