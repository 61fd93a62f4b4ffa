"""Whitening of vectors from an exact integer scatter.

Each entry c becomes the integer x = floor(STEP * c) + SHIFT. The scatter n·XᵀX - SSᵀ doesn't depend on the shift, so it is
taken off: sums and cross-products are those of y = x - SHIFT, which are small. Tasks cut y into limbs of ``LIMB`` bits,
whose products over a block of rows stay below 2**53, multiply the limbs as doubles (so without rounding), and
add them up as Python integers. A task's sums leave it as limbs, too, which Spark adds as longs; from the d·(d + 3)/2 + 1 totals
the driver forms n·XᵀX - SSᵀ as integers of any size. Only these are divided and given to ``eigh``.

Defined results: a vector that is null, empty, or holds null or non-finite entries is dropped; so is one of another length than
most (ties: the shorter one). Ids are passed on, null and repeated ones too; equal vectors count as often as they occur. Directions without
variance (an eigenvalue that is no more than rounding of the largest) make no component, so one vector, or equal ones, give no
rows, nor does an empty table. Other columns are not looked at. Whatever doesn't depend on the rows is at most 2 (d + 3) d longs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP, SHIFT = 64, 1_000_000
LIMB, BLOCK = 20, 4096  # bits; rows whose products of two limbs add up to less than 2**53
OUT = 32  # bits of a limb of a task's sums: some 2**31 tasks can be added as longs
MOST = 32  # components

_ROW = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


@dataclass(frozen=True)
class Fit:
    n: int
    sums: list[int]  # of y
    deviations: np.ndarray  # n·XᵀX - SSᵀ, as integers
    mean: np.ndarray
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column each
    trace: float


def integers(vectors: pa.Array, size: int) -> np.ndarray:
    """y of each entry; an object array of Python integers if longs don't hold them."""
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * STEP)
    if len(flat) and np.abs(flat).max() >= 2.0**62:
        out = np.empty(len(flat), object)
        out[:] = [int(v) for v in flat]
    else:
        out = flat.astype(np.int64)
    return out.reshape(-1, size)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Doubles a_k of less than 2**LIMB with y = sum of a_k · 2**(LIMB·k), signs included."""
    sign, rest, out = np.where(y < 0, -1, 1), abs(y), []
    while True:
        out.append(((rest & ((1 << LIMB) - 1)) * sign).astype(np.float64))
        rest = rest >> LIMB
        if not rest.any():
            return out


def scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the rows of y, as Python integers."""
    size = y.shape[1]
    total, product = np.zeros(size, object), np.zeros((size, size), object)
    for at in range(0, len(y), BLOCK):
        parts = limbs(y[at : at + BLOCK])
        for i, a in enumerate(parts):
            total += np.array([int(v) for v in a.sum(axis=0)], object) << (LIMB * i)
            for j, b in enumerate(parts):
                product += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total, product


def _shares(value: int) -> Iterator[tuple[int, int]]:
    sign, rest, k = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        yield k, sign * (rest & ((1 << OUT) - 1))
        rest, k = rest >> OUT, k + 1


def _partial(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(i, j, limb, value) of a task: cross-products; j = -1: sums; i = j = -1: the number of rows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, product = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            y = integers(batch["v"], size)
            a, b = scatter(y)
            n, total, product = n + len(y), total + a, product + b
        if n:
            values = [(-1, -1, n), *((i, -1, total[i]) for i in range(size)), *((i, j, product[i, j]) for i in range(size) for j in range(i, size))]
            rows = [(i, j, k, v) for i, j, value in values for k, v in _shares(int(value))]
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())], names=["i", "j", "k", "value"])

    return found


def usable(embeddings: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that remain, and their length (0: there are none)."""
    v = F.col(column)
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False)))
    own = embeddings.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    most = own.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = most[0]["size"] if most else 0
    return own.where(F.size("v") == size), size


def fit(vectors: DataFrame, size: int, most: int = MOST) -> Fit | None:
    """The components of ``vectors`` (``usable``), from the exact scatter."""
    totals = vectors.select("v").mapInArrow(_partial(size), "i int, j int, k int, value long").groupBy("i", "j", "k").agg(F.sum("value").alias("value"))
    found: dict[tuple[int, int], int] = {}
    for r in totals.collect():  # of the length of a vector, not of the rows
        found[r["i"], r["j"]] = found.get((r["i"], r["j"]), 0) + (r["value"] << (OUT * r["k"]))
    n = found.get((-1, -1), 0)
    if not n:
        return None
    sums = [found.get((i, -1), 0) for i in range(size)]
    deviations = np.zeros((size, size), object)
    covariance = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            deviations[i, j] = deviations[j, i] = n * found.get((i, j), 0) - sums[i] * sums[j]
            covariance[i, j] = covariance[j, i] = deviations[i, j] / (n * n)  # of integers: correctly rounded
    values, vectors_ = np.linalg.eigh(covariance)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    kept = min(most, int((values > values[0] * size * np.finfo(float).eps).sum())) if values[0] > 0 else 0
    trace = sum(deviations[i, i] for i in range(size)) / (n * n)
    return Fit(n, sums, deviations, np.array([s / n for s in sums]), values[:kept], np.ascontiguousarray(vectors_[:, :kept]), trace)


def _deviation(y: np.ndarray, f: Fit) -> list[int]:
    """Sum over dimensions of (n·x - S)², which the shift doesn't change, without rounding."""
    top = max(map(abs, f.sums), default=0) + f.n * (int(abs(y).max()) if y.size else 0)
    if y.dtype != object and len(f.sums) * top * top < 1 << 63:
        return ((f.n * y - np.array(f.sums, np.int64)) ** 2).sum(axis=1).tolist()
    return [int(v) for v in ((f.n * y.astype(object) - np.array(f.sums, object)) ** 2).sum(axis=1)]


def _whitened(y: np.ndarray, f: Fit) -> np.ndarray:
    return ((y.astype(np.float64) - f.mean) @ f.vectors) / np.sqrt(f.values)


def _project(f: Fit, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal

        kept = len(f.values)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                y = integers(batch["v"], size)
                deviation = [decimal.Decimal(v) if v < 10**38 else None for v in _deviation(y, f)]
                again = np.repeat(np.arange(len(y)), kept)
                yield pa.record_batch(
                    [
                        batch["vec_id"].take(pa.array(again)),
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(y))),
                        pa.array(np.full(len(again), f.n, np.int64)),
                        pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(again)),
                        pa.array(_whitened(y, f).ravel()),
                        pa.array(np.tile(f.values / f.trace, len(y))),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    return found


def _moments(f: Fit, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(i, j, value) of a task: its rows' centred products, and its means; two blocks are joined by their means."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = len(f.values)
        n, mean, product = 0, np.zeros(kept), np.zeros((kept, kept))
        for batch in batches:
            w = _whitened(integers(batch["v"], size), f)
            if not len(w):
                continue
            own = w.mean(axis=0)
            step = own - mean
            product += (w - own).T @ (w - own) + np.outer(step, step) * (n * len(w) / (n + len(w)))
            mean = mean + step * len(w) / (n + len(w))
            n += len(w)
        if n:
            # what lies between the tasks' means and the mean of all, which is subtracted at the end
            i, j = (x.ravel().astype(np.int32) for x in np.indices((kept, kept)))
            yield pa.record_batch([pa.array(i), pa.array(j), pa.array((product + n * np.outer(mean, mean)).ravel())], names=["i", "j", "value"])
            yield pa.record_batch([pa.array(np.arange(kept, dtype=np.int32)), pa.array(np.full(kept, -1, np.int32)), pa.array(n * mean)], names=["i", "j", "value"])

    return found


def identity_error(vectors: DataFrame, size: int, f: Fit) -> float:
    """The largest entry of the whitened rows' covariance, as measured over them, less the identity."""
    totals = vectors.select("v").mapInArrow(_moments(f, size), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    found = {(r["i"], r["j"]): r["value"] for r in totals.collect()}
    kept = len(f.values)
    mean = np.array([found[i, -1] for i in range(kept)]) / f.n
    covariance = np.array([[found[i, j] for j in range(kept)] for i in range(kept)]) / f.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(kept)).max())


def whiten(embeddings: DataFrame, most: int = MOST) -> DataFrame:
    """A row for each remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is exact up to 38 digits and null beyond.
    """
    vectors, size = usable(embeddings)
    found = fit(vectors, size, most) if size else None
    if found is None or not len(found.values):
        return embeddings.sparkSession.createDataFrame([], f"{_ROW}, identity_error double")
    error = identity_error(vectors, size, found)
    if not math.isfinite(error):
        raise ValueError("the whitened rows have no finite covariance")
    return vectors.mapInArrow(_project(found, size), _ROW).withColumn("identity_error", F.lit(error))
