"""Statements, queries and table definitions derived from ``events``: a table for each user, a statement from every third event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import COLUMN, RAW_LOG

#: Statements by number; {t} is the table, {n} a number from 0 to 4. The tenth drops the table where {n} is 0.
STATEMENTS = [
    "ALTER TABLE app.{t} ADD COLUMN c{n} INT AFTER name",
    "ALTER TABLE `{t}` ADD d{n} DECIMAL(10, 2) FIRST",
    "ALTER TABLE {t} DROP COLUMN c{n}, MODIFY COLUMN name TEXT",
    "ALTER TABLE {t} CHANGE c{n} e{n} BIGINT UNSIGNED",
    "ALTER TABLE {t} ADD a{n} INT, ADD b{n} INT AFTER v",
    "TRUNCATE TABLE {t}",
    "RENAME TABLE {t} TO s{n}",
    "ALTER TABLE {t} ADD INDEX i{n} (name)",
    "alter table {t} modify v BIGINT, drop d{n}",
    "ALTER TABLE {t} CHANGE COLUMN id id BIGINT",
    "CREATE TABLE IF NOT EXISTS {t} (id INT)",
    "ALTER TABLE {t} DROP COLUMN IF EXISTS v",
    "ALTER TABLE {t} ADD first{n} INT",
]
DROP = "DROP TABLE IF EXISTS {t}"
#: Queries of a binlog, for the classifier; those of even number stand inside a transaction.
QUERIES = ["BEGIN", " begin work", "COMMIT", "commit", "ROLLBACK", "SAVEPOINT a", "ALTER TABLE `app`.`{t}` ADD c INT", "create table if not exists app.{t} (id INT)", "DROP TABLE IF EXISTS {t}", "RENAME TABLE {t} TO b", "TRUNCATE app.{t}", "TRUNCATE TABLE {t}", "CREATE DATABASE q", ""]
_FILE = "mysql-bin-changelog."


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    return events.withColumn("t", F.concat(F.lit("t"), F.col("user_id").cast("string"))).withColumn("n", F.col("event_id") % 5)


def _text(templates: list[str], number: Column) -> Column:
    chosen = F.element_at(F.array(*[F.lit(t) for t in templates]), (number + 1).cast("int"))
    return F.replace(F.replace(chosen, F.lit("{t}"), F.col("t")), F.lit("{n}"), F.col("n").cast("string"))


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history's entries of six tables of seven; the log speaks of the others first."""
    tables = _events(spark, sf_dir).select("user_id", "t").distinct().where("user_id % 7 <> 0")
    own = [("id", "INT", True, False), ("name", "VARCHAR(255)", False, True), ("v", "INT", False, True)]
    columns = F.array(*[F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip((*c, None, None, None, None, i), COLUMN, strict=True)]) for i, c in enumerate(own)])
    return tables.select(F.lit("app").alias("database"), F.col("t").alias("table"), F.lit(f"{_FILE}000001").alias("binlog_file"), F.lit(4).cast("bigint").alias("position"), F.lit(0).cast("bigint").alias("put_seq"), columns.alias("columns"), F.array(F.lit("id")).alias("primary_key_columns"), F.lit(1).alias("version"), F.lit(0.0).alias("captured_at"), F.lit(None).cast("string").alias("ddl"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema records of the log."""
    k = F.floor(F.col("event_id") / 3) % len(STATEMENTS)
    own = _events(spark, sf_dir).where("event_id % 3 = 0").withColumn("k", k)
    ddl = F.when((F.col("k") == 9) & (F.col("n") == 0), _text([DROP], F.lit(0))).otherwise(_text(STATEMENTS, F.col("k")))
    place = {"kind": F.lit("schema"), "database": F.lit("app"), "table": F.col("t"), "ddl": ddl, "binlog_file": F.concat(F.lit(_FILE), F.lpad((F.floor(F.col("event_id") / 600) + 1).cast("string"), 6, "0")), "position": (F.lit(132) + F.lit(128) * (F.col("event_id") % 600)).cast("bigint"), "ts": F.lit(0.0)}
    return own.select(*[place.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_LOG])


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, query): a query of a binlog for each event."""
    return _events(spark, sf_dir).select("event_id", _text(QUERIES, F.col("event_id") % len(QUERIES)).alias("query"))


def information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as INFORMATION_SCHEMA.COLUMNS has them: an id for each table, and a column for each kind of event that its user had."""
    seen = _events(spark, sf_dir).select("t", "event_type").distinct()
    kinds = seen.groupBy("t").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))  # a handful of kinds of events
    names = kinds.select("t", F.posexplode(F.concat(F.array(F.lit("id")), "kinds")).alias("i", "name"))
    key = F.col("i") == 0
    return names.select(F.lit("app").alias("table_schema"), F.col("t").alias("table_name"), F.col("name").alias("column_name"), F.when(key, "bigint unsigned").otherwise("decimal(10,2)").alias("column_type"), F.when(key, "PRI").otherwise("").alias("column_key"), F.when(key, "NO").otherwise("YES").alias("is_nullable"), (F.col("i") + 1).alias("ordinal_position"))
