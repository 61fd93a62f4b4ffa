"""Row types of the change log, its events and the schema history."""

from __future__ import annotations

from pyspark.sql import types as T



def _struct(text: str, **given: T.DataType) -> T.StructType:
    """A struct from "name type, …" without a session, so that tasks can import this module."""
    plain = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "strings": T.ArrayType(T.StringType())}
    fields = [f.split() for f in text.split(",")]
    return T.StructType([T.StructField(n, given.get(t) or plain[t]) for n, t in fields])


COLUMN = _struct("name string, data_type string, is_primary_key boolean, is_nullable boolean, default_value string, character_set string, collation string, column_type_extra string, ordinal_position int")

#: One record of the log. ``kind``: row, schema, tx_begin or tx_commit; images are in column order.
RAW_LOG = _struct(
    "kind string, database string, table string, operation string, before_row strings, after_row strings, ddl string, "
    "binlog_file string, position bigint, gtid string, ts double, transaction_id string"
)

#: A table's columns from a position on; null columns stand for a dropped table.
SCHEMA_HISTORY = _struct(
    "database string, table string, binlog_file string, position bigint, put_seq bigint, "
    "columns columns, primary_key_columns strings, version int, captured_at double, ddl string",
    columns=T.ArrayType(COLUMN),
)

IMAGE = "array<struct<name:string,value:string,data_type:string>>"

#: MySQL type labels (without parameters) and the Spark types they are cast to.
_TYPES = {
    "tinyint": T.ByteType(), "smallint": T.ShortType(), "mediumint": T.IntegerType(), "int": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(), "char": T.StringType(), "varchar": T.StringType(), "text": T.StringType(), "enum": T.StringType(), "set": T.StringType(),
    "date": T.DateType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampType(), "time": T.StringType(), "year": T.IntegerType(),
    "binary": T.BinaryType(), "varbinary": T.BinaryType(), "blob": T.BinaryType(), "bit": T.BinaryType(), "json": T.StringType(),
}
_WIDER = {"tinyint": T.ShortType(), "smallint": T.IntegerType(), "mediumint": T.IntegerType(), "int": T.LongType(), "integer": T.LongType(), "bigint": T.DecimalType(20, 0)}


def spark_type(label: str | None) -> T.DataType:
    """The Spark type of a column's type label; unknown or missing labels are strings."""
    words = (label or "").lower().replace("(", " ( ").split()
    if not words:
        return T.StringType()
    if words[0] == "decimal":
        inside = (label or "").partition("(")[2].partition(")")[0]
        p, _, s = inside.partition(",")
        return T.DecimalType(int(p) if p.strip() else 10, int(s) if s.strip() else 0)
    if "unsigned" in words and words[0] in _WIDER:
        return _WIDER[words[0]]
    return _TYPES.get(words[0], T.StringType())
