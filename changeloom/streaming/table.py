"""A table kept up to date by micro-batches: keyed buckets of base and delta files, merged when read, compacted by bucket."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_META = ("_bucket", "_batch", "_at")


class KeyedTable:
    """The latest row of each key, in ``buckets`` by the key's hash, below ``path`` (a shared folder).

    A micro-batch writes one delta for the buckets that it touches, already cut down to its latest row per key, and no other file; a
    reader takes the greatest order among base and deltas. ``compact`` rewrites the buckets with many deltas, each into a new base, and then
    names its files in the manifest. A manifest is a small file that lists, per bucket, the folders that count. It is written last and under a new
    name, so a batch or a compaction that dies leaves nothing that a reader sees, and one that is repeated changes nothing.
    Deletes stay as rows until a compaction, which drops those (``operation`` DELETE) that no other file can contradict.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], order: list[str], buckets: int = 16, operation: str = "op"):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets, self.operation = spark, path, schema, key, order, buckets, operation
        sc = spark.sparkContext
        self._hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._hadoop.getFileSystem(sc._jsc.hadoopConfiguration())

    # ---- the manifest: {"batch": last batch, "files": {bucket: [folder, ...]}}

    def manifest(self) -> dict:
        names = [p.getPath().getName() for p in self._fs.listStatus(self._hadoop)] if self._fs.exists(self._hadoop) else []
        versions = sorted(int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-"))
        if not versions:
            return {"version": 0, "batch": -1, "files": {}}
        text = self.spark.read.text(f"{self.path}/manifest-{versions[-1]:010d}", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        """Writes the next manifest under its own name: to a hidden file first, then renamed, which fails if another writer was faster."""
        jvm = self.spark.sparkContext._jvm
        manifest = {**manifest, "version": manifest["version"] + 1}
        final = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{manifest['version']:010d}")
        hidden = jvm.org.apache.hadoop.fs.Path(f"{self.path}/.manifest-{jvm.java.util.UUID.randomUUID().toString()}")
        out = self._fs.create(hidden, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(hidden, final):
            raise RuntimeError("another writer changed the table")

    # ---- writing

    def _latest(self, rows: DataFrame) -> DataFrame:
        names = [c for c in rows.columns if c not in self.key]
        best = F.max_by(F.struct(*names), F.struct(*self.order)).alias("_best")  # combined before the shuffle
        return rows.groupBy(*self.key).agg(best).select(*self.key, *[f"_best.{n}" for n in names])

    def upsert(self, rows: DataFrame, batch_id: int) -> list[int]:
        """Adds a micro-batch; the buckets that were written. A batch that is in already changes nothing."""
        now = self.manifest()
        if batch_id <= now["batch"]:
            return []
        folder = f"delta-{batch_id:010d}-{now['version']:010d}"
        own = self._latest(rows).withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))
        own.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        touched = self._written(folder)
        for b in touched:
            now["files"].setdefault(str(b), []).append(folder)
        self._publish({**now, "batch": batch_id})
        return touched

    def _written(self, folder: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        return sorted(int(p.getPath().getName().partition("=")[2]) for p in self._fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")) if p.getPath().getName().startswith("_bucket="))

    def compact(self, most: int = 4) -> list[int]:
        """Rewrites buckets of more than ``most`` files as one base each; the buckets that were rewritten."""
        now = self.manifest()
        full = [int(b) for b, files in now["files"].items() if len(files) > most]
        if not full:
            return []
        folder = f"base-{now['batch']:010d}-{now['version']:010d}"
        kept = self._latest(self._files({str(b): now["files"][str(b)] for b in full})).where(F.coalesce(F.col(self.operation), F.lit("")) != "DELETE")
        kept.withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        left = self._written(folder)
        for b in full:
            now["files"][str(b)] = [folder] if b in left else []
        self._publish(now)
        return full

    # ---- reading

    def _files(self, files: dict[str, list[str]]) -> DataFrame:
        paths = [f"{self.path}/{folder}/_bucket={b}" for b, folders in files.items() for folder in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The table as it is: the latest row of each key, unless it is a delete."""
        return self._latest(self._files(self.manifest()["files"])).where(F.coalesce(F.col(self.operation), F.lit("")) != "DELETE")
