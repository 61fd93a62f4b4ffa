"""The keys that a sink has written, by batch and bucket, with a Bloom filter for each file, so that few files are read again."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HASHES, BITS = 6, 12  # bits a key; some 0.4 % of other keys seem to be in a filter


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits of each key: HASHES rows, from two halves of a 64-bit hash; ``size`` is a power of two."""
    h = hashes.view(np.uint64)
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(one + np.uint64(i) * two) & np.uint64(size - 1) for i in range(HASHES)]).astype(np.int64)


def made(hashes: np.ndarray) -> bytes:
    size = 1 << max(6, int(max(1, len(hashes)) * BITS - 1).bit_length())
    out = np.zeros(size, bool)
    out[_bits(hashes, size).ravel()] = True
    return np.packbits(out).tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> bool:
    """Whether one of the keys may be among those that the filter was made of."""
    bits = np.unpackbits(np.frombuffer(filter_, np.uint8)).astype(bool)
    return bool(bits[_bits(hashes, len(bits))].all(axis=0).any())


def _filter_of(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([table.num_rows], pa.int64()), "filter": pa.array([made(table["h"].to_numpy())], pa.binary())})


def _needed(key: tuple[pa.Scalar, ...], keys: pa.Table, filters: pa.Table) -> pa.Table:
    hashes = keys["h"].to_numpy()
    hit = [len(hashes) > 0 and may_hold(f, hashes) for f in filters["filter"].to_pylist()]
    return filters.select(["batch", "bucket"]).filter(pa.array(hit, pa.bool_()))


@dataclass
class KeyIndex:
    """Keys below ``path`` (a shared folder): ``keys/batch=/bucket=`` has the keys, ``filters/batch=`` a filter for each bucket.

    Which files may hold one of a batch's keys is told by bucket from the filters alone; only those are read and joined. That holds
    in whatever order batches and their positions come. A batch's own files don't count, so one that is delivered again replaces itself.
    A bucket's hashes of one batch, and its filters, meet in one task: raise ``buckets`` with the size of batches.
    """

    spark: SparkSession
    path: str
    buckets: int = 16
    files: int = 0  # of the last look-up: that there are, and that were read
    read: int = 0

    def _hashed(self, keys: DataFrame) -> DataFrame:
        h = F.xxhash64("idempotency_key")
        return keys.where("idempotency_key is not null").select("idempotency_key", h.alias("h"), F.pmod(h, F.lit(self.buckets)).cast("int").alias("bucket"))

    def _there(self, folder: str) -> bool:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path)

    def unseen(self, events: DataFrame, batch_id: int) -> DataFrame:
        """Events whose key no other batch has written; those without a key all pass."""
        self.files = self.read = 0
        if not self._there("filters"):
            return events
        filters = self.spark.read.parquet(f"{self.path}/filters").where(F.col("batch") != batch_id).select(F.col("batch").cast("long").alias("batch"), "bucket", "filter")
        keys = self._hashed(events).select("bucket", "h").distinct()
        hits = keys.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_needed, "batch long, bucket int").collect()  # names of files
        self.files, self.read = filters.count(), len(hits)
        if not hits:
            return events
        known = self.spark.read.schema("idempotency_key string").parquet(*[f"{self.path}/keys/batch={r['batch']}/bucket={r['bucket']}" for r in hits])
        return events.join(known.distinct(), "idempotency_key", "left_anti")

    def add(self, events: DataFrame, batch_id: int) -> None:
        """Keeps a batch's keys; the filters, which make them count, come last."""
        keys = self._hashed(events).distinct()
        keys.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/batch={batch_id}")
        kept = self.spark.read.schema("idempotency_key string, h long, bucket int").parquet(f"{self.path}/keys/batch={batch_id}")
        kept.select("bucket", "h").groupBy("bucket").applyInArrow(_filter_of, "bucket int, n long, filter binary").write.mode("overwrite").parquet(f"{self.path}/filters/batch={batch_id}")
