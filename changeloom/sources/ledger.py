"""What is done, as small files in a shared folder: an entry is there or it isn't."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Ledger:
    """Numbered entries below ``path``. Each is written under a hidden name and renamed, so a run that dies leaves no half of one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        sc = spark.sparkContext
        self._jvm = sc._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._folder.getFileSystem(sc._jsc.hadoopConfiguration())

    def entries(self) -> dict[int, str]:
        if not self._fs.exists(self._folder) or not any(not p.getPath().getName().startswith(".") for p in self._fs.listStatus(self._folder)):
            return {}
        rows = self.spark.read.text(self.path, wholetext=True).selectExpr("value", "_metadata.file_name AS name").collect()  # an entry each
        return {int(r["name"].removeprefix("entry-")): r["value"] for r in rows}

    def add(self, number: int, text: str) -> None:
        """Adds an entry; one that is there stays as it is."""
        final = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/entry-{number:010d}")
        if self._fs.exists(final):
            return
        hidden = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/.entry-{self._jvm.java.util.UUID.randomUUID().toString()}")
        out = self._fs.create(hidden, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(hidden, final):
            raise RuntimeError(f"could not write entry {number} of {self.path}")
