"""Settings of a pipeline, from defaults or YAML."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .operators.filters import TableFilter


@dataclass
class Database:
    host: str = "127.0.0.1"
    port: int = 3306
    user: str = "root"
    password: str = ""
    database: str = ""
    server_id: int = 1001
    connect_timeout: int = 10
    read_timeout: int = 30


# The settings' defaults, and below the names of sections and keys, which configuration files rely on.
@dataclass
class Settings:
    database: Database = field(default_factory=Database)
    source: str = "mysql"  # or "simulated", or "files"
    log_path: str | None = None  # of landed log files
    offset_path: str = "./cdc_offsets.json"
    offset_flush_ms: int = 1000
    schema_path: str = "./cdc_schema_history.json"
    include_tables: list[str] = field(default_factory=list)
    exclude_tables: list[str] = field(default_factory=list)
    include_databases: list[str] = field(default_factory=list)
    exclude_databases: list[str] = field(default_factory=list)
    staging_path: str | None = None  # where events are written before they are delivered; None: below spark.checkpoint.dir
    snapshot_enabled: bool = True
    snapshot_chunk_size: int = 1000
    batch_size: int = 100
    flush_interval_ms: int = 500
    transaction_boundaries: bool = True
    sink: dict[str, Any] = field(default_factory=lambda: {"type": "log"})

    @property
    def tables(self) -> TableFilter:
        return TableFilter(tuple(self.include_tables), tuple(self.exclude_tables), tuple(self.include_databases), tuple(self.exclude_databases))

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> Settings:
        out = cls(database=Database(**(raw.get("database") or {})), source=raw.get("source", "mysql"), log_path=raw.get("log_path"))
        for name in ("include_tables", "exclude_tables", "include_databases", "exclude_databases"):
            setattr(out, name, list(raw.get(name) or []))
        sections = {
            "snapshot": {"enabled": "snapshot_enabled", "chunk_size": "snapshot_chunk_size"},
            "delivery": {"batch_size": "batch_size", "flush_interval_ms": "flush_interval_ms", "transaction_boundary_enabled": "transaction_boundaries"},
            "offset_storage": {"path": "offset_path", "flush_interval_ms": "offset_flush_ms"},
            "schema_storage": {"path": "schema_path"},
        }
        for section, names in sections.items():
            for key, attribute in names.items():
                if key in (raw.get(section) or {}):
                    setattr(out, attribute, raw[section][key])
        out.staging_path = raw.get("staging_path", out.staging_path)
        if raw.get("sink"):
            out.sink = dict(raw["sink"])
        return out

    @classmethod
    def from_yaml(cls, path: str) -> Settings:
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text()) or {})
