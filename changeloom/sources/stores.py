"""Small state files: the committed offset and the schema history, replaced atomically."""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..schemas import SCHEMA_HISTORY


def replace_file(path: str, text: str) -> None:
    """Writes a file so that readers see the old or the new content, also after a crash."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}-")
    with os.fdopen(handle, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)


def _load(path: str) -> Any:
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None


class OffsetStore:
    """The greatest acknowledged (file, offset); lower ones and those during a snapshot are ignored."""

    def __init__(self, path: str, flush_ms: int = 1000):
        self.path, self.flush_ms, self.flushed, self.dirty, self.snapshotting = path, flush_ms, 0.0, False, False
        found = _load(path)
        position = found.get("position") if isinstance(found, dict) else None
        ok = isinstance(position, dict) and isinstance(position.get("binlog_file"), str) and isinstance(position.get("position"), int)
        self.committed: tuple[str, int] | None = (position["binlog_file"], position["position"]) if ok else None

    def ack(self, file: str | None, offset: int | None) -> bool:
        if file is None or self.snapshotting or (self.committed is not None and (file, offset or 0) <= self.committed):
            return False
        self.committed, self.dirty = (file, offset or 0), True
        if (time.time() - self.flushed) * 1000 >= self.flush_ms:
            self.flush()
        return True

    def flush(self) -> None:
        if self.dirty and self.committed:
            self.flushed, self.dirty = time.time(), False
            file, offset = self.committed
            replace_file(self.path, json.dumps({"position": {"binlog_file": file, "position": offset, "gtid": None, "timestamp": self.flushed}, "persisted_at": self.flushed}, indent=2))

    def begin_snapshot(self) -> None:
        self.snapshotting = True

    def end_snapshot(self, file: str, offset: int) -> None:
        self.snapshotting = False
        self.ack(file, offset)
        self.flush()


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """The history file as entries in order; a missing or damaged one is empty."""
    rows = []
    found = _load(path)
    for k, e in enumerate(found if isinstance(found, list) else []):
        p, s = e.get("position") or {}, e.get("schema")
        columns = None if s is None else [tuple(c.get(n) for n in ("name", "data_type", "is_primary_key", "is_nullable", "default_value", "character_set", "collation", "column_type_extra", "ordinal_position")) for c in s["columns"]]
        rows.append((e["database"], e["table"], p.get("binlog_file"), p.get("position"), k, columns, None if s is None else s.get("primary_key_columns"), None if s is None else s.get("version"), None if s is None else s.get("captured_at"), e.get("ddl")))
    return spark.createDataFrame(rows, SCHEMA_HISTORY)


def save_history(history: DataFrame, path: str) -> None:
    """Writes the history file. It is control data, a few entries per table."""
    out = []
    for r in history.orderBy("binlog_file", "position", "put_seq").toLocalIterator():
        schema = None if r.columns is None else {"database": r.database, "table": r.table, "columns": [c.asDict() for c in r.columns], "primary_key_columns": list(r.primary_key_columns or []), "version": r.version, "captured_at": r.captured_at}
        out.append({"database": r.database, "table": r.table, "position": {"binlog_file": r.binlog_file, "position": r.position, "gtid": None, "timestamp": r.captured_at}, "schema": schema, "ddl": r.ddl})
    replace_file(path, json.dumps(out, indent=2))
