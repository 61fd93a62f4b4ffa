"""A landed log as a stream of positions: offsets are (file, position), whatever the files' names and times."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schemas import RAW_LOG
from .shared import register

NAME, FOLDER, NO_FILE = "changeloom_log", "binlog_file=", "__HIVE_DEFAULT_PARTITION__"
TASK_BYTES = 128 << 20
OPEN_BYTES, ALONE = 4 << 20, 16  # what opening a file counts as, and slices up to which each is a task of its own
LANDED = 64 << 20  # bytes of the log that are landed together
LISTED = 64  # folders that are looked into at a time


@dataclass(frozen=True)
class Group:
    """A row group of a landed file: its log positions are in [low, high]."""

    path: str
    number: int
    rows: int
    size: int
    low: int
    high: int


@dataclass(frozen=True)
class Slice(InputPartition):
    """Row groups of one landed file, of which the rows in [low, high) are wanted; no bound where None."""

    file: str | None
    path: str
    groups: tuple[int, ...]
    low: int | None
    high: int | None


@dataclass(frozen=True)
class Bundle(InputPartition):
    """Slices of many small files, read by one task one after another."""

    slices: tuple[Slice, ...]


class LogReader(DataSourceStreamReader):
    """Micro-batches of a log that is landed as Parquet in folders ``binlog_file=<name>``, in the order of (file, position).

    Options: ``path``; ``start_file`` and ``start_position``, where it begins, inclusively (default: the least position); ``rows_per_batch``, with
    ``progress_path``, where what was planned and what Spark has committed is kept (a small file). A batch is of whole row groups of one
    file of the log or more, at least one; positions aren't split. Footers tell the ranges, and only those of files at or after
    the offset are read. The log is appended to: what lands behind the offset isn't seen. Rows without a file come first (as file ""),
    rows without a position count as 0. An empty or missing folder is an empty log.
    """

    def __init__(self, options: dict[str, str], schema: StructType):
        self.store, self.base = fs.FileSystem.from_uri(options["path"])
        self.schema = schema
        self.first = {"file": options.get("start_file", ""), "position": int(options.get("start_position", 0 if "start_file" in options else -(1 << 62)))}
        self.limit = int(options["rows_per_batch"]) if "rows_per_batch" in options else None
        self.progress = options.get("progress_path")
        if self.limit is not None and (self.limit < 1 or not self.progress):
            raise ValueError("rows_per_batch is at least 1 and needs progress_path")
        self.groups: dict[str, list[Group]] = {}  # by landed file; these don't change
        self.planned: dict | None = None

    def __getstate__(self) -> dict:
        """What executors get: slices tell them all that they read, so what is known of the log stays behind."""
        return {**self.__dict__, "groups": {}, "planned": None}

    # what is kept beside the checkpoint: a limited batch starts where the one before was planned to end
    def _kept(self) -> dict:
        if not self.progress:
            return {}
        store, path = fs.FileSystem.from_uri(self.progress)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return {}
        with store.open_input_stream(path) as f:
            return json.loads(f.read())

    def _keep(self, **news: dict) -> None:
        if self.progress:
            text = json.dumps(self._kept() | news).encode()
            store, path = fs.FileSystem.from_uri(self.progress)
            store.create_dir(path.rpartition("/")[0])
            hidden = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as f:
                f.write(text)
            store.move(hidden, path)

    def _folders(self) -> list[tuple[str, str]]:
        """The log's files in order, with their folders."""
        found = self.store.get_file_info(fs.FileSelector(self.base, allow_not_found=True))
        names = {i.path: unquote(i.base_name.removeprefix(FOLDER)) for i in found if i.base_name.startswith(FOLDER)}
        return sorted(("" if n == NO_FILE else n, path) for path, n in names.items())

    def _in_order(self, folders: list[tuple[str, str]]) -> Iterator[tuple[str, list[Group]]]:
        """Names and row groups of the log's files, some folders at a time."""
        with ThreadPoolExecutor(16) as pool:
            for k in range(0, len(folders), LISTED):
                some = folders[k : k + LISTED]
                yield from zip([name for name, _ in some], pool.map(self._groups, [path for _, path in some]), strict=True)

    def _groups(self, folder: str) -> list[Group]:
        """The row groups of one file of the log, by their ends."""
        out: list[Group] = []
        for info in self.store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.endswith(".parquet") and info.base_name[0] not in "._":
                if info.path not in self.groups:
                    self.groups[info.path] = self._footer(info.path)
                out += self.groups[info.path]
        return sorted(out, key=lambda g: (g.high, g.path, g.number))

    def _footer(self, path: str) -> list[Group]:
        with self.store.open_input_file(path) as f:
            file = pq.ParquetFile(f)
            column = file.schema_arrow.names.index("position")
            out = []
            for i in range(file.num_row_groups):
                group = file.metadata.row_group(i)
                if not group.num_rows:
                    continue
                stats = group.column(column).statistics
                if stats is not None and stats.has_min_max and stats.has_null_count and not stats.null_count:
                    low, high = stats.min, stats.max
                else:  # without statistics, or with nulls: one column tells
                    at = pc.min_max(pc.fill_null(file.read_row_group(i, ["position"])["position"], 0))
                    low, high = at["min"].as_py(), at["max"].as_py()
                out.append(Group(path, i, group.num_rows, group.total_byte_size, low, high))
            return out

    def _end(self, start: dict) -> dict:
        """The end (exclusive) of a batch from ``start`` on."""
        at, taken = start, 0
        folders = [(n, p) for n, p in self._folders() if n >= start["file"]]
        if self.limit is None:  # the last file tells
            for name, path in reversed(folders):
                groups = self._groups(path)
                if groups:
                    return max(start, {"file": name, "position": groups[-1].high + 1}, key=_order)
            return start
        for name, groups in self._in_order(folders):
            for g in groups:
                end = {"file": name, "position": g.high + 1}
                if _order(end) <= _order(start):
                    continue
                if taken and taken + g.rows > self.limit and _order(end) > _order(at):
                    return at
                at, taken = end, taken + g.rows
        return at

    def initialOffset(self) -> dict:
        return self.first

    def latestOffset(self) -> dict:
        if self.planned is None:
            self.planned = self._kept().get("planned", self.first)
        end = self._end(self.planned)
        if end != self.planned and self.limit is not None:
            self._keep(planned=end)
        self.planned = end
        return end

    def partitions(self, start: dict, end: dict) -> list[Slice | Bundle]:
        out: list[tuple[Slice, int]] = []
        for name, all_groups in self._in_order([(n, p) for n, p in self._folders() if start["file"] <= n <= end["file"]]):
            low = start["position"] if name == start["file"] else None
            high = end["position"] if name == end["file"] else None
            by_file: dict[str, list[Group]] = {}
            for g in all_groups:
                if (low is None or g.high >= low) and (high is None or g.low < high):
                    by_file.setdefault(g.path, []).append(g)
            for path, groups in by_file.items():
                part: list[Group] = []
                for g in sorted(groups, key=lambda g: g.number):
                    if part and sum(p.size for p in part) + g.size > TASK_BYTES:
                        out.append((Slice(name or None, path, tuple(p.number for p in part), low, high), sum(p.size for p in part)))
                        part = []
                    part.append(g)
                out.append((Slice(name or None, path, tuple(p.number for p in part), low, high), sum(p.size for p in part)))
        return _bundled(out)

    def read(self, partition: Slice | Bundle) -> Iterator[pa.RecordBatch]:
        for one in partition.slices if isinstance(partition, Bundle) else (partition,):
            yield from self._read(one)

    def _read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        want = to_arrow_schema(self.schema)
        with self.store.open_input_file(partition.path) as f:
            file = pq.ParquetFile(f)
            columns = [n for n in want.names if n in file.schema_arrow.names and n != "binlog_file"]
            for batch in file.iter_batches(4096, row_groups=list(partition.groups), columns=[*columns, *({"position"} - {*columns})]):
                at = pc.fill_null(batch["position"], 0)
                if partition.low is not None:
                    batch = batch.filter(pc.greater_equal(at, partition.low))
                    at = pc.fill_null(batch["position"], 0)
                if partition.high is not None:
                    batch = batch.filter(pc.less(at, partition.high))
                made = [pa.array([partition.file] * batch.num_rows, pa.string()) if n == "binlog_file" else batch[n] if n in columns else pa.nulls(batch.num_rows) for n in want.names]
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([m.cast(t.type) for m, t in zip(made, want, strict=True)], schema=want)

    def commit(self, end: dict) -> None:
        self._keep(committed=end)

    def stop(self) -> None:
        pass


def _bundled(slices: list[tuple[Slice, int]]) -> list[Slice | Bundle]:
    """Slices (with their bytes) as tasks: a task for each small file would cost far more than its rows."""
    if len(slices) <= ALONE:
        return [s for s, _ in slices]
    out, room = [], 0
    for one, size in slices:
        if not out or size + OPEN_BYTES > room:
            out.append([])
            room = TASK_BYTES
        out[-1].append(one)
        room -= size + OPEN_BYTES
    return [Bundle(tuple(some)) for some in out]


def _order(offset: dict) -> tuple[str, int]:
    return offset["file"], offset["position"]


class LogSource(DataSource):
    """``readStream.format("changeloom_log")``; see ``LogReader``. The columns are those of a log record unless a schema is given."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return RAW_LOG

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(dict(self.options), schema)


def land(log: DataFrame, path: str) -> None:
    """Appends records in the layout that the stream reads: a folder per file of the log, sorted by position."""
    # the number is given, or many files of few bytes would be written by one task, a folder after another; a small file isn't divided
    log.repartitionByRange(2 * log.sparkSession.sparkContext.defaultParallelism, "binlog_file", F.floor(F.col("position") / LANDED)).sortWithinPartitions("binlog_file", "position").write.mode("append").partitionBy("binlog_file").parquet(path)


def stream_positions(spark: SparkSession, path: str, schema: StructType = RAW_LOG, committed: tuple[str, int] | None = None, rows_per_batch: int | None = None, progress_path: str | None = None) -> DataFrame:
    """The log as a stream from the committed position on, which is delivered again; a checkpoint takes precedence over it."""
    register(spark, LogSource)
    reader = spark.readStream.format(NAME).schema(schema).option("path", path)
    if committed is not None:
        reader = reader.option("start_file", committed[0]).option("start_position", committed[1])
    if rows_per_batch is not None:
        reader = reader.option("rows_per_batch", rows_per_batch)
    return (reader.option("progress_path", progress_path) if progress_path else reader).load()
