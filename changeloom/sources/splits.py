"""Even ranges of any key, composite or text, and a read of a table by such ranges that can be resumed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import Ledger

SAMPLED = 256  # keys of the sketch for each range: ranges differ by some 1 / sqrt(SAMPLED)


def bounds(rows: DataFrame, key: list[str], ranges: int) -> list[tuple]:
    """At most ``ranges`` - 1 keys that cut the rows in even ranges, ascending; nulls count as least.

    The sketch is the ``SAMPLED`` · ``ranges`` rows whose hashed keys are least, which is a uniform sample of the distinct keys, whatever
    their order or type, of bounded size. It is made in one pass over the key's columns alone.
    """
    sketch = rows.select(*key).orderBy(F.xxhash64(*key)).limit(SAMPLED * ranges)
    found = [tuple(r) for r in sketch.orderBy(*key).collect()]  # of bounded size
    picked = [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []
    return list(dict.fromkeys(picked))


def _below(key: list[str], bound: tuple) -> Column:
    """Whether a row's key comes before ``bound``, column by column, as nulls first do."""
    out = F.lit(False)
    for name, value in reversed(list(zip(key, bound, strict=True))):
        column = F.col(name)
        less = F.lit(False) if value is None else column.isNull() | (column < F.lit(value))
        same = column.isNull() if value is None else column.isNotNull() & (column == F.lit(value))
        out = less | (same & out)
    return out


def predicates(key: list[str], cuts: list[tuple]) -> list[Column]:
    """A predicate for each range; every row, also one with nulls in its key, fulfils exactly one."""
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        inside = F.lit(True) if low is None else ~_below(key, low)
        out.append(inside if high is None else inside & _below(key, high))
    return out


class SplitRead:
    """Reads a table in ranges and keeps each below ``path`` (a shared folder); a range in the ledger isn't read again.

    The bounds are the ledger's entry 0 of their own folder, so that a run that resumes has the same ones.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], ranges: int = 64):
        self.spark, self.path, self.key, self.ranges = spark, path, key, ranges
        self.done = Ledger(spark, f"{path}/ledger")

    def cuts(self, rows: DataFrame) -> list[tuple]:
        path = f"{self.path}/bounds"
        kept = Ledger(self.spark, f"{self.path}/bounds-ledger")
        if 0 not in kept.entries():
            found = bounds(rows, self.key, self.ranges)
            schema = rows.select(*self.key).schema
            self.spark.createDataFrame(found, schema).coalesce(1).write.mode("overwrite").parquet(path)
            kept.add(0, str(len(found)))
        return [tuple(r) for r in self.spark.read.parquet(path).orderBy(*self.key).collect()]

    def run(self, rows: DataFrame, most: int | None = None, read: Callable[[Column], DataFrame] | None = None) -> list[int]:
        """Reads what is left (``most`` ranges); ``read`` gives the rows that fulfil a predicate, by default a filter of ``rows``. The ranges read."""
        wanted = predicates(self.key, self.cuts(rows))
        left = [i for i in range(len(wanted)) if i not in self.done.entries()][:most]
        for i in left:
            (read or rows.where)(wanted[i]).write.mode("overwrite").parquet(f"{self.path}/rows/_range={i}")
            self.done.add(i, str(i))
        return left

    def rows(self) -> DataFrame:
        """All rows read so far, with ``_range``."""
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/_range={i}" for i in sorted(self.done.entries())])
