"""A deterministic change log derived from the ``events`` table.

Four rows make a transaction with a begin and a commit, some of which are missing;
some transactions are delivered twice. It feeds the registered queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE, SLOTS = "mysql-bin-changelog.", 600  # slots of a log file
WIDEN = "ALTER TABLE app.user_state ADD COLUMN props TEXT AFTER event_type"


def _tx() -> F.Column:
    return F.floor(F.col("event_id") / 4).cast("bigint")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "props")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    op = F.when(F.col("event_type") == "error", "DELETE").when(before.isNull() | (before == "error"), "INSERT").otherwise("UPDATE")
    table = F.when(F.col("user_id") % 5 == 0, "audit").otherwise("user_state")
    return events.select((_tx() * 6 + 1 + F.col("event_id") % 4).alias("slot"), _tx().alias("tx"), F.lit("row").alias("kind"), table.alias("tbl"), op.alias("op"), "user_id", "event_type", "value", "props")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot, tx, kind, tbl, op, the row's own columns, binlog_file and position."""
    own = rows(spark, sf_dir)
    tx = spark.read.parquet(f"{sf_dir}/events.parquet").select(_tx().alias("tx")).distinct()
    nothing = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in own.columns[3:]]
    begin = tx.where("tx % 11 <> 3").select((F.col("tx") * 6).alias("slot"), "tx", F.lit("tx_begin").alias("kind"), *nothing)
    commit = tx.where("tx % 13 <> 5").select((F.col("tx") * 6 + 5).alias("slot"), "tx", F.lit("tx_commit").alias("kind"), *nothing)
    number = (F.floor(F.col("slot") / SLOTS) + 1).cast("string")
    file = F.concat(F.lit(FILE), F.lpad(number, 6, "0")).alias("binlog_file")
    return own.unionByName(begin).unionByName(commit).select("*", file, (F.lit(4) + F.lit(128) * (F.col("slot") % SLOTS + 1)).alias("position"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with idempotency_key and dedup_key."""
    from ..functions.keys import dedup_key, idempotency_key, key_text

    key = key_text(F.when(F.col("user_id").isNotNull(), F.create_map(F.lit("user_id"), F.col("user_id").cast("string"))))
    source = F.lit("mysql")
    return log(spark, sf_dir).select("*", idempotency_key(source, F.col("binlog_file"), F.col("position"), F.col("kind"), key).alias("idempotency_key"), dedup_key(source, F.lit("app"), F.col("tbl"), key).alias("dedup_key"))


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in delivery order, every tenth transaction twice."""
    own = events(spark, sf_dir)
    again = own.where("tx % 10 = 0")
    return own.select(F.col("slot").alias("delivery_seq"), *own.columns).union(again.select((F.col("slot") + 1_000_000_000).alias("delivery_seq"), *own.columns))


def _cents(value: str) -> F.Column:
    return F.round(F.col(value) * 100).cast("bigint").cast("string")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as records with positional images, and the statement that widens one table; the images of the other widen without one."""
    own = log(spark, sf_dir)
    at = Window.partitionBy("user_id").orderBy("slot")
    was = {c: F.lag(c).over(at).alias(f"was_{c}") for c in ("event_type", "props", "value")}
    rows_ = own.where("kind = 'row'").select("*", *was.values())
    wide = ((F.col("tbl") == "user_state") & (F.col("binlog_file") >= f"{FILE}000002")) | ((F.col("tbl") == "audit") & (F.col("binlog_file") >= f"{FILE}000003"))

    def image(prefix: str) -> F.Column:
        cells = [F.col("user_id").cast("string"), F.col(f"{prefix}event_type"), F.col(f"{prefix}props"), _cents(f"{prefix}value")]
        return F.when(wide, F.array(*cells)).otherwise(F.array(*cells[:2], cells[3]))

    nothing = F.lit(None).cast("array<string>")
    tx, gtid = F.concat(F.lit("tx-"), F.col("tx").cast("string")).alias("transaction_id"), F.lit(None).cast("string").alias("gtid")
    text = lambda name: F.lit(None).cast("string").alias(name)
    place = ["binlog_file", "position", gtid, F.col("slot").cast("double").alias("ts"), tx]
    changes = rows_.select("kind", F.lit("app").alias("database"), F.col("tbl").alias("table"), F.col("op").alias("operation"), F.when(F.col("op") != "INSERT", image("was_")).otherwise(nothing).alias("before_row"), F.when(F.col("op") != "DELETE", image("")).otherwise(nothing).alias("after_row"), text("ddl"), *place)
    marks = own.where("kind <> 'row'").select("kind", text("database"), text("table"), text("operation"), nothing.alias("before_row"), nothing.alias("after_row"), text("ddl"), *place)
    ddl = spark.range(1).select(F.lit("schema").alias("kind"), F.lit("app").alias("database"), F.lit("user_state").alias("table"), text("operation"), nothing.alias("before_row"), nothing.alias("after_row"), F.lit(WIDEN).alias("ddl"), F.lit(f"{FILE}000002").alias("binlog_file"), F.lit(4).cast("bigint").alias("position"), gtid, F.lit(0.0).alias("ts"), text("transaction_id"))
    return changes.unionByName(marks).unionByName(ddl)


def full_history(spark: SparkSession) -> DataFrame:
    """``history`` as the engine keeps it: columns with types, the key, the version."""
    own = history(spark)
    columns = F.transform(F.split("cols", ","), lambda n, i: F.struct(n.alias("name"), F.lit("VARCHAR(64)").alias("data_type"), (n == "user_id").alias("is_primary_key"), (n != "user_id").alias("is_nullable"), *[F.lit(None).cast("string").alias(c) for c in ("default_value", "character_set", "collation", "column_type_extra")], i.alias("ordinal_position")))
    return own.select(F.lit("app").alias("database"), F.col("tbl").alias("table"), "binlog_file", "position", "put_seq", columns.alias("columns"), F.array(F.lit("user_id")).alias("primary_key_columns"), "version", F.lit(0.0).alias("captured_at"), F.lit(None).cast("string").alias("ddl"))


def binlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as raw binlog events: begins and, of odd transactions, commits are queries; of even ones commits are XIDs."""
    own = log(spark, sf_dir)
    event = F.when(F.col("kind") == "tx_begin", "QueryEvent").when(F.col("kind") == "tx_commit", F.when(F.col("tx") % 2 == 0, "XidEvent").otherwise("QueryEvent")).when(F.col("op") == "INSERT", "WriteRowsEvent").when(F.col("op") == "UPDATE", "UpdateRowsEvent").otherwise("DeleteRowsEvent")
    query = F.when(F.col("kind") == "tx_begin", " begin").when((F.col("kind") == "tx_commit") & (F.col("tx") % 2 == 1), "COMMIT")
    one = F.struct(F.when(F.col("op") != "INSERT", F.array(F.col("user_id").cast("string"))).alias("before"), F.when(F.col("op") != "DELETE", F.array(F.col("user_id").cast("string"))).alias("after"))
    twice = F.when(F.col("kind") == "row", F.when(F.col("user_id") % 7 == 0, F.array(one, one)).otherwise(F.array(one)))
    return own.select(event.alias("event"), F.lit("app").alias("database"), F.col("tbl").alias("table"), query.alias("query"), twice.alias("rows"), "binlog_file", "position", F.lit(0.0).alias("ts"))


def history(spark: SparkSession) -> DataFrame:
    """Versions of the two tables' columns, as the history has them (names and positions)."""
    return spark.sql(
        f"""SELECT tbl, binlog_file, CAST(position AS BIGINT) AS position, CAST(put_seq AS BIGINT) AS put_seq, version, ncols, cols FROM VALUES
        ('user_state', '{FILE}000001', 1000, 1, 1, 3, 'user_id,event_type,value'), ('user_state', '{FILE}000002', 4, 2, 2, 4, 'user_id,event_type,props,value'),
        ('audit', '{FILE}000001', 4, 3, 1, 3, 'user_id,event_type,value') AS t(tbl, binlog_file, position, put_seq, version, ncols, cols)"""
    )


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a snapshot at the log's begin: the smaller user ids, and some that the log never touches."""
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    own = ids.where("user_id < 100").union(ids.where("user_id < 20").select(F.col("user_id") + 100000))
    return own.select("user_id", F.when(F.col("user_id") % 5 == 0, "audit").otherwise("user_state").alias("tbl"), F.lit(f"{FILE}000001").alias("binlog_file"), F.lit(4).alias("position"))
