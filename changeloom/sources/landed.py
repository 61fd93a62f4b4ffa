"""Change logs landed as files, read at once or as a stream, and binlog events turned into log records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ddl import statement_kind, table_of
from ..functions.positions import resume
from ..schemas import RAW_LOG


def read_log(spark: SparkSession, path: str, format: str = "parquet", committed: tuple[str, int] | None = None) -> DataFrame:
    """A landed log from the committed position on. Partition it by binlog_file, and older files aren't even listed."""
    return resume(spark.read.schema(RAW_LOG).format(format).load(path), committed)


def stream_log(spark: SparkSession, path: str, format: str = "json", files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(RAW_LOG).format(format).option("maxFilesPerTrigger", files_per_trigger).load(path)


def from_binlog_events(events: DataFrame) -> DataFrame:
    """Records of raw binlog events: event (class name), database, table, query, rows (array of before and after), binlog_file, position, ts.

    Rows events give a record for each row, all at one position. QUERY events are begins,
    commits or statements; XID events are commits. A transaction is named by the position of
    its begin, and as none spans two files, the naming is a window within a file.
    """
    in_file = Window.partitionBy("binlog_file").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("binlog_file").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    query = F.col("event") == "QueryEvent"
    begins = query & F.upper(F.trim("query")).startswith("BEGIN")
    ends = (F.col("event") == "XidEvent") | (query & F.upper(F.trim("query")).startswith("COMMIT"))
    here = F.struct("position", F.concat(F.lit("tx-"), F.col("binlog_file"), F.lit("-"), F.col("position").cast("string")).alias("name"))
    marked = events.withColumn("_begin", F.max(F.when(begins, here)).over(in_file)).withColumn("_end", F.max(F.when(ends, F.col("position"))).over(before))
    is_open = F.coalesce(F.col("_begin.position") > F.coalesce("_end", F.lit(-1)), F.lit(False))
    kind = F.when(query, statement_kind(F.col("query"), is_open)).when(F.col("event") == "XidEvent", "tx_commit").otherwise("row")
    op = F.when(F.col("event").startswith("WriteRows"), "INSERT").when(F.col("event").startswith("UpdateRows"), "UPDATE").when(F.col("event").startswith("DeleteRows"), "DELETE").otherwise("UNKNOWN")
    own = marked.withColumn("kind", kind).where("kind is not null")
    tx = F.when(is_open, F.col("_begin.name")).when(F.col("kind") == "tx_commit", here["name"])
    own = own.withColumn("transaction_id", tx).withColumn("row", F.explode_outer("rows")).where("kind <> 'row' or row is not null")
    schema = F.col("kind") == "schema"
    return own.select("kind", "database", F.when(schema, table_of(F.col("query"))).otherwise(F.col("table")).alias("table"), F.when(F.col("kind") == "row", op).alias("operation"), F.col("row.before").alias("before_row"), F.col("row.after").alias("after_row"), F.when(schema, F.col("query")).alias("ddl"), "binlog_file", "position", F.lit(None).cast("string").alias("gtid"), "ts", "transaction_id")
