"""Files that count once they are published: tasks write their own, the commit of a batch lists them."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..sources.shared import register
from .base import Sink

NAME = "changeloom_published"


@dataclass
class Written(WriterCommitMessage):
    """What an attempt of a task has written; no name if it had no rows."""

    name: str | None
    rows: int


class _Files:
    """``path/data`` has the files of all attempts, ``path/_published`` an entry for each batch, with the names of those that count."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema.json()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = fs.FileSystem.from_uri(self.path)
        name, rows, writer = f"{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if batch.num_rows:
                    if writer is None:
                        store.create_dir(f"{base}/data")
                        writer = pq.ParquetWriter(f"{base}/data/{name}", batch.schema, filesystem=store)
                    writer.write_batch(batch)
                    rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written(name if rows else None, rows)

    def publish(self, messages: list[Written | None], batch: int) -> None:
        """Publishes a batch; one that is there stays as it is, and the new files go."""
        store, base = fs.FileSystem.from_uri(self.path)
        final = f"{base}/_published/batch-{batch:012d}"
        if store.get_file_info(final).type != fs.FileType.NotFound:
            with store.open_input_stream(final) as f:
                listed = {x["name"] for x in json.loads(f.read())["files"]}
            self.discard([m for m in messages if m is not None and m.name not in listed])
            return
        files = [asdict(m) for m in messages if m is not None and m.name]
        store.create_dir(f"{base}/_published")
        hidden = f"{base}/_published/.{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as f:
            f.write(json.dumps({"batch": batch, "files": files, "schema": self.schema}).encode())
        store.move(hidden, final)

    def discard(self, messages: list[Written | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.name and store.get_file_info(f"{base}/data/{m.name}").type != fs.FileType.NotFound:
                store.delete_file(f"{base}/data/{m.name}")


class _Batch(DataSourceArrowWriter):
    def __init__(self, files: _Files, batch: int):
        self.files, self.batch = files, batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.files.write(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.files.publish(messages, self.batch)

    def abort(self, messages: list[Written | None]) -> None:
        self.files.discard(messages)


class _Stream(DataSourceStreamArrowWriter):
    def __init__(self, files: _Files):
        self.files = files

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.files.write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.files.publish(messages, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.files.discard(messages)


class PublishedFiles(DataSource):
    """``write`` or ``writeStream`` ``.format("changeloom_published")`` with ``path`` and, for ``write``, ``batch_id``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> _Batch:
        if overwrite:
            raise ValueError("batches are appended; one that is published isn't written again")
        return _Batch(_Files(self.options["path"], schema), int(self.options["batch_id"]))

    def streamWriter(self, schema: StructType, overwrite: bool) -> _Stream:
        return _Stream(_Files(self.options["path"], schema))


class PublishedSink(Sink):
    """Batches as Parquet files that are seen all at once or not at all.

    What a task wrote before it failed, or a batch before its commit, is never seen (``sweep`` removes it); a batch id that was
    published before changes nothing, whatever it brings now. One writer at a time. Column types are those that Parquet has.
    """

    def __init__(self, path: str):
        self.path = path

    def deliver(self, events: DataFrame, batch_id: int) -> None:
        register(events.sparkSession, PublishedFiles)
        events.write.format(NAME).mode("append").option("path", self.path).option("batch_id", batch_id).save()

    def batches(self) -> list[dict]:
        """The published batches in order, with their files and rows."""
        return [{k: b[k] for k in ("batch", "files")} for b in _entries(self.path)]

    def events(self, spark: SparkSession, schema: StructType | None = None) -> DataFrame:
        return published(spark, self.path, schema)

    def sweep(self, older_than_s: float = 86_400) -> int:
        """Removes files that no batch lists and that are older (attempts that run now are younger); their number."""
        store, base = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(f"{base}/data", allow_not_found=True))  # before the entries: what is published since is younger
        listed = {f["name"] for b in _entries(self.path) for f in b["files"]}
        old = [i.path for i in found if i.base_name not in listed and time.time() - i.mtime.timestamp() >= older_than_s]
        for path in old:
            store.delete_file(path)
        return len(old)


def _entries(path: str) -> list[dict]:
    store, base = fs.FileSystem.from_uri(path)
    out = []
    for info in store.get_file_info(fs.FileSelector(f"{base}/_published", allow_not_found=True)):
        if info.base_name.startswith("batch-"):
            with store.open_input_stream(info.path) as f:
                out.append(json.loads(f.read()))
    return sorted(out, key=lambda b: b["batch"])


def published(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The rows of all published batches; of none, no rows of ``schema``."""
    entries = _entries(path)
    if schema is None:
        if not entries:
            raise ValueError(f"nothing is published in {path}; give a schema")
        schema = StructType.fromJson(json.loads(entries[-1]["schema"]))
    files = [f"{path.rstrip('/')}/data/{f['name']}" for b in entries for f in b["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
