"""As-of join: the schema that was active at a record's position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of history (as text) that are broadcast at most; beyond, log and history meet in ranges of the log.
BROADCAST_BYTES = 32 << 20
RANGE = 1 << 26  # of a file's positions


def intervals(history: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each entry with the position of the next (``n_file``, ``n_pos``); the first holds for all before it, too.

    Of entries at one position the last counts.
    """
    last = Window.partitionBy(*keys, "binlog_file", "position").orderBy(*[F.col(c).desc() for c in order])
    by_table = Window.partitionBy(*keys).orderBy("binlog_file", "position")
    one = history.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")
    return one.select("*", F.lead("binlog_file").over(by_table).alias("n_file"), F.lead("position").over(by_table).alias("n_pos"), (F.row_number().over(by_table) == 1).alias("is_first"))


def schema_at(log: DataFrame, history: DataFrame, keys: tuple[str, ...] = ("database", "table"), order: tuple[str, ...] = ("put_seq",), broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``log`` left-joined with the entry at or before each record (before all: the first; no position: the latest).

    The history is control data. Up to a measured number of bytes it is broadcast, as a hash join on the
    table with the interval as residual, so the log isn't shuffled. The history's columns are prefixed h_.
    """
    size = history.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*history.columns)))), F.lit(0))).first()[0]
    return by_interval(log, history, keys, order) if size <= broadcast_bytes else by_range(log, history, keys, order)


def by_interval(log: DataFrame, history: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    h = intervals(history, list(keys), list(order))
    h = F.broadcast(h.select(*[F.col(c).alias(f"h_{c}") for c in h.columns]))
    from_here = (log["binlog_file"] > h["h_binlog_file"]) | ((log["binlog_file"] == h["h_binlog_file"]) & (log["position"] >= h["h_position"]))
    to_here = h["h_n_file"].isNull() | (log["binlog_file"] < h["h_n_file"]) | ((log["binlog_file"] == h["h_n_file"]) & (log["position"] < h["h_n_pos"]))
    unplaced = log["binlog_file"].isNull() & h["h_n_file"].isNull()
    condition = unplaced | ((h["h_is_first"] | from_here) & to_here)
    for k in keys:
        condition = (log[k] == h[f"h_{k}"]) & condition
    return log.join(h, condition, "left").drop("h_n_file", "h_n_pos", "h_is_first")


def by_range(log: DataFrame, history: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], size: int = RANGE) -> DataFrame:
    """The same without a broadcast: records and entries of a table stand side by side in ranges of a file's positions.

    Inside a range the last entry is carried from row to row; what is carried into it is the last entry before it (or the table's first), which is found
    among one row per range and the entries alone. So a table of any size is dealt to as many tasks as its log has ranges.
    Records of no position meet their table's latest entry in a join by table, and those of no table none.
    """
    mine = Window.partitionBy(*keys, "binlog_file", "position").orderBy(*[F.col(c).desc() for c in order])
    one = history.withColumn("_last", F.row_number().over(mine)).where("_last = 1").drop("_last")
    entry = F.struct(*[F.col(c).alias(f"h_{c}") for c in history.columns])
    place = F.struct("binlog_file", "position")
    key = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    spot = F.floor(F.col("position") / size)
    entries = one.select(*key, F.col("binlog_file").alias("_f"), spot.alias("_r"), place.alias("_at"), entry.alias("_entry"))
    known = log["binlog_file"].isNotNull() & F.lit(True)
    for k in keys:
        known = known & log[k].isNotNull()
    row = F.struct(*[log[c] for c in log.columns])
    rows = log.where(known).select(*key, F.col("binlog_file").alias("_f"), spot.alias("_r"), place.alias("_at"), row.alias("_row"))

    # what is carried into a range
    own = Window.partitionBy(*ks).orderBy("_f", "_r").rowsBetween(Window.unboundedPreceding, -1)
    last = entries.groupBy(*ks, "_f", "_r").agg(F.max_by("_entry", "_at").alias("_top"))
    ranges = rows.select(*ks, "_f", "_r").distinct().join(last, [*ks, "_f", "_r"], "full")
    first = entries.groupBy(*ks).agg(F.min_by("_entry", "_at").alias("_first"))
    carried = ranges.withColumn("_before", F.last("_top", ignorenulls=True).over(own)).join(first, ks, "left").select(*ks, "_f", "_r", F.coalesce("_before", "_first").alias("_before"))

    # entries come before the records at their position
    both = rows.withColumn("_entry", F.lit(None).cast(entries.schema["_entry"].dataType)).unionByName(entries.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    inside = Window.partitionBy(*ks, "_f", "_r").orderBy("_at", F.col("_entry").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_here", F.last("_entry", ignorenulls=True).over(inside)).where(F.col("_row").isNotNull())
    placed = seen.join(carried, [*ks, "_f", "_r"], "left").select("_row.*", F.coalesce("_here", "_before").alias("_e"))
    latest = entries.groupBy(*ks).agg(F.max_by("_entry", "_at").alias("_e"))
    loose = log.where(~F.coalesce(known, F.lit(False))).select(*key, row.alias("_row")).withColumn("_unplaced", F.col("_row.binlog_file").isNull())
    rest = loose.join(latest, ks, "left").select("_row.*", F.when(F.col("_unplaced"), F.col("_e")).alias("_e"))
    return placed.unionByName(rest).select(*log.columns, "_e.*")
