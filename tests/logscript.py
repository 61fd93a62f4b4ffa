"""A scripted log for tests and demos, as a table or as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from changeloom.schemas import RAW_LOG

FIRST, STEP = 4, 128
RECORD = tuple[Any, ...]


class LogScript:
    """Records in order. Each call takes the next position; transactions are named by their begin."""

    def __init__(self, file: str = "mysql-bin-changelog.000001", position: int = FIRST, ts: float = 0.0):
        self.file, self.at, self.ts, self.tx, self.records = file, position, ts, None, []

    def _add(self, kind: str, database=None, table=None, operation=None, before=None, after=None, ddl=None) -> LogScript:
        self.at += STEP
        if kind == "tx_begin":
            self.tx = f"tx-{self.file}-{self.at}"
        text = lambda row: None if row is None else [None if v is None else str(v) for v in row]
        self.records.append((kind, database, table, operation, text(before), text(after), ddl, self.file, self.at, None, self.ts, self.tx))
        if kind == "tx_commit":
            self.tx = None
        return self

    def rotate(self, file: str) -> LogScript:
        self.file, self.at = file, FIRST
        return self

    def begin(self) -> LogScript:
        return self._add("tx_begin")

    def commit(self) -> LogScript:
        if self.tx is None:
            self.begin()
        return self._add("tx_commit")

    def insert(self, database: str, table: str, row: list) -> LogScript:
        return self._add("row", database, table, "INSERT", None, row)

    def update(self, database: str, table: str, before: list, after: list) -> LogScript:
        return self._add("row", database, table, "UPDATE", before, after)

    def delete(self, database: str, table: str, row: list) -> LogScript:
        return self._add("row", database, table, "DELETE", row)

    def ddl(self, database: str, table: str | None, statement: str) -> LogScript:
        return self._add("schema", database, table, ddl=statement)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.records, RAW_LOG)

    def files(self, path: str, records_per_file: int) -> int:
        """Lands the records as JSON files for a file stream."""
        import json
        from pathlib import Path

        Path(path).mkdir(parents=True, exist_ok=True)
        names = RAW_LOG.names
        for n, k in enumerate(range(0, len(self.records), records_per_file)):
            lines = [json.dumps(dict(zip(names, r, strict=True))) for r in self.records[k : k + records_per_file]]
            Path(path, f"part-{n:05d}.json").write_text("\n".join(lines) + "\n")
        return -(-len(self.records) // records_per_file)


class _Reader(SimpleDataSourceStreamReader):
    """Serves the script so many records at a time; the offset is the number served."""

    def __init__(self, records: list[RECORD], step: int):
        self.records, self.step = records, step

    def initialOffset(self) -> dict:
        return {"served": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(len(self.records), start["served"] + self.step)
        return iter(self.records[start["served"] : end]), {"served": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.records[start["served"] : end["served"]])


def scripted_source(script: LogScript, name: str = "scripted_log", records_per_batch: int = 6) -> type[DataSource]:
    """A data source class to register: ``spark.dataSource.register(...)``, then ``readStream.format(name)``."""
    records, label = list(script.records), name

    class Scripted(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self):
            return RAW_LOG

        def simpleStreamReader(self, schema):
            return _Reader(records, records_per_batch)

    return Scripted
