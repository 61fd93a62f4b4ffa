"""Target-distribution importance resampling over hashed n-grams of words.

A text's features are its runs of one to three words, each hashed to a bucket (CRC-32 modulo ``BUCKETS``). From the bucket counts of all
documents and of the target's texts follows a gain for each bucket; a document's weight is the sum of the gains of its
features, its score that weight plus Gumbel noise, drawn by its id. The highest scores are drawn: sampling without replacement by weight.

Scoring takes no exploded rows: higher-order functions make each document's array of buckets, and the weight is an aggregate over ``element_at``
of a literal array of gains. What is shuffled are counts by bucket (at most BUCKETS a task), scores, and nothing else.
Ranks come from one sort by score, dealt by ranges, and the numbers of rows of the ranges before.

Defined results: null and empty texts have no features and weigh 0; a null id draws the noise of an empty one and ranks
after equal scores; rows with one id and equal scores rank in any order among themselves; without target texts all gains follow from
the documents alone, and an empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, new_folder

BUCKETS = 10_000
SEED = 42
LEAST_WORDS, PERCENT = 20, 5
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Runs of digits, small letters and characters beyond ASCII, after lower-casing A-Z only."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    # a break at either end leaves one empty string there
    return F.array_remove(F.split(lower, BREAK), "")


def featured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``features``, the array of the buckets of all runs of one to three words."""
    n = F.size("_tokens")
    first = lambda c, k: F.slice(c, 1, F.greatest(n - k, F.lit(0)))  # noqa: E731  cut, so that zip_with pads nothing
    rest = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    own = docs.withColumn("_tokens", words(F.col(text))).withColumn("_pairs", F.zip_with(first("_tokens", 1), rest("_tokens"), joined))
    triples = F.zip_with(first("_tokens", 2), rest("_pairs"), joined)
    features = F.transform(F.concat("_tokens", "_pairs", triples), lambda s: (F.crc32(s) % BUCKETS).cast("int"))
    return own.withColumn("n_words", n).withColumn("features", features).drop("_tokens", "_pairs")


def counts(features: DataFrame) -> list[int]:
    """How many features of all rows each bucket holds."""
    # outer: else Spark would infer a filter on the array, and make it twice
    per = features.select(F.explode_outer("features").alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n")).collect()  # BUCKETS rows at most
    out = [0] * BUCKETS
    for r in per:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Each bucket's log ratio of smoothed shares, in thousandths, rounded down."""
    all_source, all_target = float(sum(source) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log(((t + 1.0) * all_source) / ((s + 1.0) * all_target))) for s, t in zip(source, target, strict=True)]


def noise(doc_id: Column) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(features: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of (doc_id, n_words, features)."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to a literal
    weight = F.aggregate("features", F.lit(0).cast("long"), lambda total, b: total + F.element_at(table, b + 1))
    out = features.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("features").cast("long").alias("n_features"), weight.alias("weight"))
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of each document."""
    spark = docs.sparkSession
    path = new_folder(spark, "features")  # made once, read for the counts and for the scores
    featured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text").write.parquet(path)
    source = spark.read.parquet(path)
    gain = gains(counts(source), counts(featured(target.select("text"))))
    all_ = held(scored(source, gain))
    long = F.col("n_words") >= least_words
    # a global sort is dealt by ranges; a row's number is its number inside its range, after the rows of the ranges before
    sorted_ = held(all_.where(long).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")).withColumn("at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r["n"] for r in sorted_.groupBy(part.alias("part")).count().withColumnRenamed("count", "n").collect()}  # one row a range
    drawn, before, starts = percent * sum(sizes.values()) // 100, 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    first = spark.createDataFrame(starts, "part long, before long")
    ranked = sorted_.withColumn("part", part).join(F.broadcast(first), "part").withColumn("rank", F.col("before") + inside + 1)
    names = ["doc_id", "n_features", "weight", "score"]
    ranked = ranked.select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.union(all_.where(~long).select(*names, F.lit(None).cast("long")))
