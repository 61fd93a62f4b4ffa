"""Which tables are captured. Empty lists don't restrict; names are compared exactly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableFilter:
    include_tables: tuple[str, ...] = ()
    exclude_tables: tuple[str, ...] = ()
    include_databases: tuple[str, ...] = ()
    exclude_databases: tuple[str, ...] = ()

    def matches(self, database: Column, table: Column) -> Column:
        full, ok = F.concat_ws(".", database, table), F.lit(True)
        for column, names, wanted in ((full, self.exclude_tables, False), (database, self.exclude_databases, False), (database, self.include_databases, True), (full, self.include_tables, True)):
            if names:
                ok = ok & (column.isin(*names) if wanted else ~column.isin(*names))
        return ok

    def apply(self, log: DataFrame) -> DataFrame:
        """Rows of captured tables; statements of captured or unknown tables; all transaction marks."""
        own = F.coalesce(self.matches(F.col("database"), F.col("table")), F.lit(False))
        unknown = F.coalesce(F.col("table"), F.lit("")) == ""
        return log.where(F.when(F.col("kind") == "row", own).when(F.col("kind") == "schema", unknown | own).otherwise(F.lit(True)))


def without_boundaries(log: DataFrame) -> DataFrame:
    """With transaction boundaries off there are no marks, and rows belong to no transaction."""
    return log.where(~F.col("kind").isin("tx_begin", "tx_commit")).withColumn("transaction_id", F.lit(None).cast("string"))
