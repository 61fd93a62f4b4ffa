"""What the operators share: the shared folder, materialising, byte tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"
SLICE = 1 << 20  # bytes of text that a worker works on at a time: several arrays of 8 bytes a byte may stand beside them


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session that runs in one process and names none gets a temporary one.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="changeloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path if "://" in path else f"file://{path}"


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh URI under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary array (null: empty) and its n + 1 offsets."""
    array = pc.fill_null(array, "" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, off, data = array.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``most`` bytes of ``column``, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, base = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(at, end - at)
            at, base = end, int(size[min(end, len(size)) - 1])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and text number of every run of bytes other than 0x20 and 0x09-0x0D."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    cut = np.zeros(len(data) + 1, bool)  # where another text begins
    cut[offsets[:-1]] = True
    start = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x2545F4914F6CDD1D)


_WINDOW = 1 << 16
with np.errstate(over="ignore"):
    _POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(_WINDOW, _BASE, np.uint64)]))
    _INVERSES = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(_WINDOW, pow(int(_BASE), -1, 1 << 64), np.uint64)]))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (spans ascend and don't overlap), by prefix sums of a polynomial modulo 2**64.

    The sums are made for one window of the bytes after another, so memory beside the result is that of a window;
    a span longer than a window is added up in pieces.
    """
    out = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        k = 0
        while k < len(start):
            base = start[k]
            upto = max(k + 1, int(np.searchsorted(end, base + _WINDOW, side="right")))
            if end[upto - 1] - base <= _WINDOW:
                own = data[base : end[upto - 1]]
                total = np.zeros(len(own) + 1, np.uint64)
                np.cumsum(_TABLE[own] * _POWERS[: len(own)], out=total[1:])
                a, b = start[k:upto] - base, end[k:upto] - base
                out[k:upto] = (total[b] - total[a]) * _INVERSES[a]
            else:
                shift = np.uint64(1)
                for at in range(base, end[k], _WINDOW):
                    own = data[at : min(at + _WINDOW, end[k])]
                    out[k] += (_TABLE[own] * _POWERS[: len(own)]).sum(dtype=np.uint64) * shift
                    shift *= _POWERS[_WINDOW]
            k = upto
        return mix(out + (end - start).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


BROADCAST_ROWS = 100_000  # rows of a few longs: some 10 MB at most, so that all broadcasts of a query fit the driver together


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, counted no further than that."""
    return df.limit(rows + 1).count() <= rows


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is (then joins shuffle)."""
    return F.broadcast(df) if is_small(df, rows) else df


LIGHT, HEAVY_KEYS = 128, 50_000


def spread_join(many: DataFrame, one: DataFrame, key: str | list[str], by: str, how: str = "inner", counts: DataFrame | None = None, narrow: bool = False, rows: int | None = None) -> DataFrame:
    """``many`` joined with ``one`` on ``key``, which is unique in ``one``, so that no task gets a hot key whole.

    A key with very many rows in ``many`` is dealt to parts by the hash of the column ``by``; its row of ``one`` is
    copied for each part. Heavy keys have more than 1 / HEAVY_KEYS of all rows, so there are at most HEAVY_KEYS
    of them, which bounds what is broadcast. ``many`` is read thrice: hold what is dear. ``counts`` (key, n) may be given.
    Few rows of longs are broadcast themselves (``narrow``). ``rows``: a known bound on the rows of ``many``.
    """
    keys = [key] if isinstance(key, str) else key
    rows = many.count() if rows is None else rows
    if narrow and rows <= BROADCAST_ROWS:
        return F.broadcast(many).join(one, keys, how)
    most = max(LIGHT, rows // HEAVY_KEYS)
    n = counts if counts is not None else many.groupBy(*keys).agg(F.count("*").alias("n"))
    heavy = n.where(F.col("n") > most).select(*[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("n") / most).alias("_parts"))
    heavy = F.broadcast(held(heavy))
    same = lambda df: [df[k] == heavy[f"_{k}"] for k in keys]
    drop = ["_parts", *[f"_{k}" for k in keys]]
    left = many.join(heavy, same(many), "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0).cast("long"))).drop(*drop)
    right = one.join(heavy, same(one), "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1))).drop(*drop)
    return left.join(right, [*keys, "_part"], how).drop("_part")
