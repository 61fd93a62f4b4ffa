"""Folders that driver and executors share, and data sources that sessions share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh URI below ``spark.checkpoint.dir``; only a session of one process that names none gets a temporary folder."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="changeloom-")
    return f"{(path if '://' in path or path.startswith('file:') else f'file://{path}').rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Registers a data source, unless a session of the same process has."""
    try:
        spark.dataSource.register(source)
    except AnalysisException as e:
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise
