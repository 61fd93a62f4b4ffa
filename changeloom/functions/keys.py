"""Keys by which deliveries are told apart. Their formats are fixed: consumers store them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_text(primary_key: Column) -> Column:
    """k1=v1|k2=v2, by name, from a map; a null value reads None, no key is empty."""
    parts = F.transform(F.array_sort(F.map_keys(primary_key)), lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at(primary_key, k), F.lit("None"))))
    return F.coalesce(F.array_join(parts, "|"), F.lit(""))


def idempotency_key(source: Column, file: Column, offset: Column, kind: Column, key: Column, qualified_by: Column | None = None) -> Column:
    """source:file:position:kind:key. It has no table in it; ``qualified_by`` adds one where equal keys of two tables at one position must differ."""
    parts = [source, F.coalesce(file, F.lit("")), F.coalesce(offset, F.lit(0)).cast("string"), kind]
    if qualified_by is not None:
        parts.append(qualified_by)
    return F.concat_ws(":", *parts, F.coalesce(key, F.lit("")))


def dedup_key(source: Column, database: Column, table: Column, key: Column) -> Column:
    """source:database:table:key; null without a key."""
    return F.when(F.coalesce(key, F.lit("")) != "", F.concat_ws(":", source, database, table, key))


def batch_key(keys: str) -> Column:
    """Aggregate: SHA-256 of a batch's sorted keys."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(keys)), "|"), 256)
