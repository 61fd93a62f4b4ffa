"""Consistent snapshots of tables: rows with their columns, all at one log position."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import TableFilter
from ..schemas import COLUMN, SCHEMA_HISTORY


@dataclass
class SnapshotTable:
    """A table as a DataFrame of typed columns, with its database, name and primary key."""

    database: str
    table: str
    rows: DataFrame
    primary_key: list[str]
    labels: dict[str, str] = field(default_factory=dict)  # type labels, by column, if not Spark's own

    def columns(self) -> list[tuple]:
        return [(f.name, self.labels.get(f.name, f.dataType.simpleString()), f.name in self.primary_key, f.nullable, None, None, None, None, i) for i, f in enumerate(self.rows.schema)]


@dataclass
class Snapshot:
    """Tables and the position at which the log continues."""

    binlog_file: str
    position: int
    tables: list[SnapshotTable]

    def chosen(self, spark: SparkSession, tables: TableFilter) -> list[SnapshotTable]:
        names = spark.createDataFrame([(t.database, t.table) for t in self.tables], "database string, table string")
        kept = {tuple(r) for r in names.where(tables.matches(F.col("database"), F.col("table"))).collect()}
        return [t for t in self.tables if (t.database, t.table) in kept]

    def history(self, spark: SparkSession, tables: TableFilter = TableFilter()) -> DataFrame:
        """The tables' columns as entries of the schema history, at the snapshot's position."""
        rows = [(t.database, t.table, self.binlog_file, self.position, k, t.columns(), t.primary_key, 1, 0.0, None) for k, t in enumerate(self.chosen(spark, tables))]
        return spark.createDataFrame(rows, SCHEMA_HISTORY)

    def rows(self, spark: SparkSession, tables: TableFilter = TableFilter()) -> DataFrame:
        """database, table, columns, primary_key_columns and row of all rows; each table is one parallel scan."""
        out = spark.createDataFrame([], f"database string, table string, columns array<{COLUMN.simpleString()}>, primary_key_columns array<string>, row array<string>")
        for t in self.chosen(spark, tables):
            cells = F.array(*[F.col(f"`{c}`").cast("string") for c in t.rows.columns])
            columns = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(c, COLUMN, strict=True)]) for c in t.columns()])
            out = out.union(t.rows.select(F.lit(t.database), F.lit(t.table), columns, F.array(*[F.lit(k) for k in t.primary_key]).cast("array<string>"), cells))
        return out


def schema_entries(columns: DataFrame, binlog_file: str, position: int, tables: TableFilter = TableFilter()) -> DataFrame:
    """Entries of the schema history from rows as INFORMATION_SCHEMA.COLUMNS has them, at the snapshot's position.

    Columns stand in their ordinal order, numbered from 0; the key is those marked PRI. Defaults are not kept.
    A table's columns are gathered in one row, which the server's limit on columns bounds.
    """
    own = columns.where(tables.matches(F.col("table_schema"), F.col("table_name")))
    text = lambda name: (F.col(name) if name in columns.columns else F.lit(None)).cast("string")
    values = {
        "name": F.col("column_name"), "data_type": F.col("column_type"), "is_primary_key": F.coalesce(F.col("column_key") == "PRI", F.lit(False)), "is_nullable": F.coalesce(F.upper(text("is_nullable")) == "YES", F.lit(True)),
        "character_set": text("character_set_name"), "collation": text("collation_name"), "column_type_extra": text("extra"),
    }
    one = F.struct(F.col("ordinal_position").cast("int").alias("_o"), *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in COLUMN if f.name != "ordinal_position"])
    gathered = own.groupBy(F.col("table_schema").alias("database"), F.col("table_name").alias("table")).agg(F.array_sort(F.collect_list(one)).alias("_c"))
    made = F.transform("_c", lambda c: F.struct(*[c[f.name].alias(f.name) for f in COLUMN if f.name != "ordinal_position"], (c["_o"] - 1).alias("ordinal_position")))
    key = F.transform(F.filter("_c", lambda c: c["is_primary_key"]), lambda c: c["name"])
    place = {"binlog_file": F.lit(binlog_file), "position": F.lit(position), "put_seq": F.lit(0), "columns": made, "primary_key_columns": key, "version": F.lit(1), "captured_at": F.lit(0.0), "ddl": F.lit(None)}
    return gathered.select("database", "table", *[place[f.name].cast(f.dataType).alias(f.name) for f in SCHEMA_HISTORY if f.name in place])


def page(rows: DataFrame, primary_key: list[str], number: int, size: int = 1000) -> DataFrame:
    """One page by primary key, for consumers that page. Each page sorts anew: prefer the whole scan."""
    if not primary_key:
        raise ValueError("pages of a table without a primary key are not stable")
    return rows.orderBy(*primary_key).offset(number * size).limit(size)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "''") + "'"


def information(database: str) -> str:
    """The query for a database's base tables: a row for each column in order, with its full type and whether it is in the key."""
    return (
        "(SELECT c.TABLE_NAME t, c.COLUMN_NAME c, c.COLUMN_TYPE d, c.COLUMN_KEY k, c.ORDINAL_POSITION o FROM INFORMATION_SCHEMA.COLUMNS c JOIN INFORMATION_SCHEMA.TABLES b"
        f" ON b.TABLE_SCHEMA = c.TABLE_SCHEMA AND b.TABLE_NAME = c.TABLE_NAME WHERE b.TABLE_TYPE = 'BASE TABLE' AND c.TABLE_SCHEMA = {_quoted(database)}) x"
    )


def tables_of(columns: list, database: str, tables: TableFilter = TableFilter(), names: list[str] | None = None) -> dict[str, list]:
    """The columns (t, c, d, k, o) of each table wanted, in order."""
    out: dict[str, list] = {}
    for r in sorted(columns, key=lambda r: (r.t, r.o)):
        full = f"{database}.{r.t}"
        barred = full in tables.exclude_tables or database in tables.exclude_databases or (tables.include_databases and database not in tables.include_databases) or (tables.include_tables and full not in tables.include_tables)
        if not barred and (names is None or r.t in names):
            out.setdefault(r.t, []).append(r)
    return out


def jdbc_tables(spark: SparkSession, url: str, database: str, properties: dict[str, str], tables: TableFilter = TableFilter(), names: list[str] | None = None, partitions: int = 64) -> list[SnapshotTable]:
    """Tables of a database by JDBC (its driver must be on the class path), those that the filter passes.

    A table with one integer key column is read in ``partitions`` ranges of it, in parallel; others by one task. Executors can't
    share one database transaction, so a consistent position needs a read-only or quiesced source, or a single connection.
    """
    found = spark.read.jdbc(url, information(database), properties=properties).collect()  # one row per column
    out = []
    for t, own in tables_of(found, database, tables, names).items():
        key, name, ranges = [r for r in own if r.k == "PRI"], f"{database}.{t}", {}
        if len(key) == 1 and "int" in key[0].d.lower():
            lo, hi = spark.read.jdbc(url, f"(SELECT MIN({key[0].c}) lo, MAX({key[0].c}) hi FROM {name}) x", properties=properties).first()
            if lo is not None:
                ranges = {"column": key[0].c, "lowerBound": int(lo), "upperBound": int(hi) + 1, "numPartitions": partitions}
        out.append(SnapshotTable(database, t, spark.read.jdbc(url, name, properties=properties, **ranges), [r.c for r in key], {r.c: r.d for r in own}))
    return out
