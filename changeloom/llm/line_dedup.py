"""Lines that repeat earlier lines, exactly or within a few edits.

Lines (cut at newlines) are compared in lower case with runs of white space as one
space; blank lines, and others of fewer than ``exact_chars`` characters (default: 1), are left alone, and near ones
need ``MIN_CHARS`` characters. A line goes if it
is not the first of its equals, or if an earlier line is within ``edits`` insertions,
deletions or substitutions of a character ("earlier": by doc_id, then line number).
The default, which the SQL has too, is one edit. With more, the bound of two lines grows with
the shorter one: an edit for each ``MIN_CHARS`` characters, up to ``edits``.

One edit goes by a deletion neighbourhood. Two lines within one edit share a variant: the line itself or the line less
one character. With one edit, lines that lost a character at the same position
and became equal are all within one substitution of each other, and a variant that is a
line itself is one insertion from all that became it. So each group of equal
variants only passes on its earliest line, by grouped minima: no pairs within
groups, and none missed. As one edit leaves the first or second half of a line as it is,
only lines that share a half (at the lengths in question) with another line
emit variants, and only of the other half. What is found is verified by
edit distance.

More edits go by pieces: of k + 1 pieces of the shorter line, k edits leave one as it
is in the longer line, shifted by no more than the edits before and after it. Lines that share a
piece at such a place are paired and verified by edit distance.

Null texts stay null and empty texts empty, without lines that count. A null doc_id comes
first. Rows equal in doc_id and text are one document; rows that share a doc_id but differ in
text are ordered by the text's hash. Extra columns stay as they are. An empty table gives no rows. A very long text is split into
its lines inside one row, and a very long line is one value of a row; neither is copied for its variants but in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_broadcast, held, is_small, mix, signed, slices, spread_join

MIN_CHARS = 16
LISTED = 1_000_000  # lines in the lists that are broadcast at most (some 60 MB); what joins with them is whole texts

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _lines(docs: DataFrame, exact_chars: int) -> DataFrame:
    """doc_id, t (hash of the text), line, h, g (hashes of the compared form) and norm of every line that counts."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    lower = F.trim(F.lower("raw"))
    odd = F.contains("raw", F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains("raw", F.lit(c))
    # the pattern is slow, and few lines need it
    lines = lines.withColumn("norm", F.when(odd, F.trim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "))).otherwise(lower)).where(F.length("norm") >= exact_chars)
    return lines.select("doc_id", "t", "line", F.xxhash64("norm").alias("h"), F.hash("norm").alias("g"), "norm")


def _half_keys() -> Column:
    """First and second half of the line, cut as for its length, then as for one character less (hashes)."""
    n = F.length("norm")
    out = []
    for size in (n, n - 1):
        half = F.floor(size / 2).cast("int")
        out.append(F.xxhash64(F.lit(0), size, F.substring("norm", F.lit(1), half)))
        out.append(F.xxhash64(F.lit(1), size, F.substring("norm", n - (size - half) + 1, size - half)))
    return F.array(*out)


def deletion_hashes(text: str) -> tuple[int, np.ndarray]:
    """Hash of the text, and of the text without its k-th character for every k."""
    c = mix(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1))
    n = len(c)
    with np.errstate(over="ignore"):
        power = np.full(n, _BASE, np.uint64)
        power[:1] = 1
        np.multiply.accumulate(power, out=power)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * power, dtype=np.uint64)])
        less = upto[:-1] + (upto[-1] - upto[1:]) * np.uint64(pow(int(_BASE), -1, 1 << 64))
        return int(mix(upto[-1:] + np.uint64(n))[0]), mix(less + np.uint64(n - 1))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "norm", 1 << 18):
        keys, at, rows = [], [], []
        columns = (batch["norm"].to_pylist(), batch["first_half"].to_pylist(), batch["second_half"].to_pylist())
        for row, (text, first, second) in enumerate(zip(*columns, strict=True)):
            _, less = deletion_hashes(text)
            n = len(text)
            lo, hi = (0 if second else (n - 1) // 2), (n if first else n // 2 + 1)
            keys.append(less[lo:hi])
            at.append(np.arange(lo, hi, dtype=np.int32))
            rows.append(np.full(hi - lo, row))
        yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(at)), batch["h"].take(pa.array(np.concatenate(rows)))], ["variant", "at", "h"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = np.array([deletion_hashes(t)[0] for t in batch["norm"].to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(signed(own)), batch["h"]], ["variant", "shorter"])


def piece_keys(texts: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, key and own of the pieces of each text (own), and of what may be a piece of a text as long or shorter."""
    c = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    n = np.array([len(t) for t in texts], np.int64)
    off = np.cumsum(n) - n
    rows, keys, own = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    with np.errstate(over="ignore"):
        power, inverse = np.full(len(c), _BASE, np.uint64), np.full(len(c) + 1, pow(int(_BASE), -1, 1 << 64), np.uint64)
        power[:1] = inverse[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(inverse, out=inverse)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(c + np.uint64(1)) * power, dtype=np.uint64)])
        for k in range(1, edits + 1):
            for less in range(k + 1):  # the other text has so many characters less
                m = n - less
                row = np.flatnonzero((m >= MIN_CHARS) & (np.minimum(m // MIN_CHARS, edits) == k))
                m, at = m[row], off[row]
                for i in range(k + 1):
                    lo, hi = m * i // (k + 1), m * (i + 1) // (k + 1)
                    # as many edits as pieces before this one, or after it, leave an earlier, or later, piece whole
                    for shift in range(max(-i, less - (k - i)), min(i, less + (k - i)) + 1):
                        a, b = at + lo + shift, at + hi + shift
                        rows.append(row)
                        keys.append(mix((upto[b] - upto[a]) * inverse[a] + mix((m * 64 + i).astype(np.uint64))))
                        own.append(np.full(len(row), less == shift == 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(own)


def _near_by_pieces(lines: DataFrame, edits: int) -> DataFrame:
    """h and g of the lines (of ``MIN_CHARS`` characters at least) that have an earlier line within the bound."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "norm", 1 << 20):
            row, key, own = piece_keys(batch["norm"].to_pylist(), edits)
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(own), batch["h"].take(pa.array(row))], ["key", "own", "h"])

    # keys are many and cheap: made twice, never kept
    keys = lines.select("h", "norm").mapInArrow(pieces, "key long, own boolean, h long")
    shared = held(keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("own").alias("own")).where("own and lo <> hi").select("key"))
    hits = held(keys.join(bounded_broadcast(shared), "key").groupBy("key", "h").agg(F.max("own").alias("own")))
    pairs = hits.where("own").select("key", F.col("h").alias("a")).join(hits.select("key", F.col("h").alias("b")), "key").where("a <> b")
    pairs = held(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    some = held(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct())
    texts = lines.join(bounded_broadcast(some), "h").groupBy("h", "g").agg(F.first("norm").alias("norm"), F.min(F.struct("doc_id", "t", "line")).alias("place"))
    texts = held(texts)
    one, other = (texts.select(*[F.col(c).alias(f"{side}_{c}" if c != "h" else side) for c in texts.columns]) for side in "ab")
    both = pairs.join(one, "a").join(other, "b")
    bound = F.least(F.lit(edits), F.floor(F.least(F.length("a_norm"), F.length("b_norm")) / MIN_CHARS))
    both = both.where(F.levenshtein("a_norm", "b_norm", edits).between(0, bound))
    later = F.when(F.col("a_place") < F.col("b_place"), F.struct(F.col("b").alias("h"), F.col("b_g").alias("g"))).otherwise(F.struct(F.col("a").alias("h"), F.col("a_g").alias("g")))
    return both.select(later.alias("later")).select("later.*").distinct()


def _near_by_deletions(lines: DataFrame, where: DataFrame, place: Column) -> DataFrame:
    """h and g of the lines that have an earlier line within one edit."""
    # lines that share a half with another line, and which: the edit is in the other one
    halves = where.select("h", "g", F.posexplode("halves").alias("side", "key"))
    shared = held(halves.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key"))
    likely = held(halves.join(bounded_broadcast(shared), "key", "left_semi").groupBy("h", "g").agg(F.max(F.col("side") % 2 == 0).alias("first_half"), F.max(F.col("side") % 2 == 1).alias("second_half")))
    long = where.where("halves is not null").select("doc_id", "t", "line", "h", "g")
    mine = F.broadcast(likely) if is_small(likely, BROADCAST_ROWS) else likely
    there = long.join(mine, ["h", "g"]) if mine is not likely else spread_join(long, likely, ["h", "g"], "t")
    # a line's text is read at its first place, so that a common line is no hot key
    first = held(there.groupBy("h", "g").agg(F.min(place).alias("place"), F.first("first_half").alias("first_half"), F.first("second_half").alias("second_half")))
    at = bounded_broadcast(first.select(F.col("h").alias("_h"), F.col("g").alias("_g"), "place", "first_half", "second_half"))
    same = lines["doc_id"].eqNullSafe(at["place.doc_id"]) & (lines["t"] == at["place.t"]) & (lines["line"] == at["place.line"])
    texts = held(lines.join(at, same).select("h", "g", "norm", "place", "first_half", "second_half").dropDuplicates(["h", "g"]))

    # variants are many and cheap: made twice, never kept. First those that lines share, then who has them
    less = texts.mapInArrow(_variants, "variant long, at int, h long")
    common = held(less.groupBy("variant", "at").agg(F.count("*").alias("n")).where("n > 1").select("variant", "at"))
    whole = held(texts.mapInArrow(_whole, "variant long, shorter long"))
    hits = less.join(bounded_broadcast(common.withColumn("swap", F.lit(True))), ["variant", "at"], "left").join(bounded_broadcast(whole), "variant", "left")
    hits = held(hits.where("swap or shorter is not null"))

    # each group passes on its earliest line only
    who = texts.select("h", F.struct("place", "h").alias("who"))
    swaps = hits.where("swap").select("variant", "at", "h").join(who, "h")
    swaps = swaps.join(swaps.groupBy("variant", "at").agg(F.min("who").alias("best")), ["variant", "at"]).select("who", "best")
    inserts = hits.where("shorter is not null").select("h", "shorter").distinct().join(who, "h").join(who.select(F.col("h").alias("shorter"), F.col("who").alias("other")), "shorter")
    found = swaps.union(inserts.select("who", "other")).union(inserts.select("other", "who"))
    near = found.groupBy("who").agg(F.min("best").alias("best")).where(F.col("best.place") < F.col("who.place")).select("who.h", F.col("best.h").alias("bh"))
    text = texts.select("h", "g", "norm")
    near = near.join(text, "h").join(text.select(F.col("h").alias("bh"), F.col("norm").alias("other")), "bh")
    return near.where(F.levenshtein("norm", "other", 1) >= 0).select("h", "g")


def find_repeats(docs: DataFrame, edits: int = 1, exact_chars: int = 1) -> DataFrame:
    """doc_id, t, line and near of every line that goes (near: an earlier line is within the bound)."""
    lines = _lines(docs, max(exact_chars, 1))
    long = F.length("norm") >= MIN_CHARS
    place = F.struct("doc_id", "t", "line")
    where = held(lines.select("doc_id", "t", "line", "h", "g", *([F.when(long, _half_keys()).alias("halves")] if edits == 1 else [])))
    near = _near_by_deletions(lines, where, place) if edits == 1 else _near_by_pieces(lines.where(long), edits)
    near = bounded_broadcast(held(near.select("h", "g", F.lit(True).alias("near"))))

    first = where.groupBy("h", "g").agg(F.min(place).alias("kept"), F.count("*").alias("n"))
    going = held(first.join(near, ["h", "g"], "left").withColumn("near", F.coalesce("near", F.lit(False))).where("n > 1 or near"))
    places, rest = where.select("doc_id", "t", "line", "h", "g"), going.select("h", "g", "kept", "near")
    # common lines may be very common: beyond the bound their places are dealt to parts
    found = places.join(F.broadcast(rest), ["h", "g"]) if is_small(going, BROADCAST_ROWS) else spread_join(places, rest, ["h", "g"], "t", counts=going.select("h", "g", "n"))
    # a struct with a null doc_id equals itself only null-safely
    return found.where(F.col("near") | ~place.eqNullSafe(F.col("kept"))).select("doc_id", "t", "line", "near")


def _without(docs: DataFrame, edits: int, exact_chars: int) -> DataFrame:
    """doc (the whole row), text (without what goes), n_lines, n_exact and n_near."""
    gone = held(find_repeats(docs, edits, exact_chars))
    per_doc = gone.groupBy("doc_id", "t").agg(F.collect_set("line").alias("gone_lines"), F.countDistinct(F.when(F.col("near"), F.col("line"))).alias("n_near"))
    # the bound is on the lines in all lists
    per_doc = (F.broadcast(per_doc) if is_small(gone, LISTED) else per_doc).withColumnsRenamed({"doc_id": "gone_id", "t": "gone_t"})
    # whole rows in a struct, so that no name can clash
    rows = docs.select(F.struct("*").alias("doc")).withColumn("parts", F.split("doc.text", "\n"))
    joined = rows.join(per_doc, F.col("doc.doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("doc.text") == F.col("gone_t")), "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone_lines"), lambda i: F.get("parts", i))
    text = F.when(F.col("gone_lines").isNull() | F.col("doc.text").isNull(), F.col("doc.text")).otherwise(F.array_join(kept, "\n"))
    n_gone, n_near = F.coalesce(F.size("gone_lines"), F.lit(0)), F.coalesce("n_near", F.lit(0))
    n_lines = F.when(F.col("doc.text").isNull(), 0).otherwise(F.size("parts"))
    return joined.select("doc", text.alias("text"), n_lines.cast("long").alias("n_lines"), F.when(n_gone > 0, n_gone - n_near).otherwise(0).cast("long").alias("n_exact"), n_near.cast("long").alias("n_near"))


def _own(docs: DataFrame, less: tuple[str, ...] = ()) -> list[Column]:
    return [(F.col("text") if c == "text" else F.col("doc").getField(c)).alias(c) for c in docs.columns if c not in less]


def without_repeats(docs: DataFrame, edits: int = 1, exact_chars: int = 1) -> DataFrame:
    """The documents with ``text`` less the lines that go, and n_lines, n_exact and n_near (replacing columns of these names)."""
    counts = ("n_lines", "n_exact", "n_near")
    return _without(docs, edits, exact_chars).select(*_own(docs, counts), *counts)


def cleaned(docs: DataFrame, edits: int = 1, exact_chars: int = 1) -> DataFrame:
    """As ``without_repeats``, but all columns other than ``text`` stay as they are, and documents of which nothing is left go."""
    gone = (F.col("n_exact") + F.col("n_near") > 0) & F.col("text").rlike(r"^[\x20\x09-\x0D]*\z")
    return _without(docs, edits, exact_chars).where(~F.coalesce(gone, F.lit(False))).select(*_own(docs))
