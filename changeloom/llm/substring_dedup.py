"""Removal of passages that occur earlier: windows of words found by anchors on a difference cover.

A window is ``WINDOW`` consecutive words (runs of other bytes than 0x20 and 0x09-0x0D) of one document. A word goes if
a window over it starts earlier, too: in a document with a smaller id, or before in the same one. Windows are judged on the input.

Shipping each window would take as many rows as there are words. Anchors of ``ANCHOR`` words are taken at word
positions whose remainder by ``PERIOD`` is in ``COVER`` instead. Every remainder is a difference of two members of the cover, so
two equal windows, however they lie, hold an equal anchor at the same place inside of them. An anchor that is met once
can't be part of a repeat; the windows round the others are hashed whole (96 bits), and all but the first of a hash go.

Groups of copies: rows whose whole text occurs under a smaller id only lose all their windows, so after the anchors they take no further part.
Anchors that a sample of the documents shows to be frequent go unshuffled as repeated (their windows are compared
like all others), and windows over them are compared in parts first. The sample decides where rows go, never what is found.

Defined results: a null text is an empty one and has no words; a null id comes after all others; rows with one id are one
document whose texts lie side by side, so that words at equal places of them don't repeat each other; equal rows get equal results; other columns are
not looked at, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import mix, signed, slices, span_hashes, spread_join, text_bytes, words_of

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)  # every remainder by 13 is a difference of two of these
ANCHOR = WINDOW - PERIOD + 1
SAMPLED, OFTEN, HOT = 32, 16, 50_000  # one document in SAMPLED tells which anchors come OFTEN; so many are told apart at most
PARTS = 4096  # of a frequent window's rows
LAST = (1 << 63) - 1

_random = np.random.default_rng(20)
_TIMES = _random.integers(0, 1 << 63, (3, WINDOW), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _summed(words: np.ndarray, n: int, lane: int) -> np.ndarray:
    """A hash of each ``n`` consecutive word hashes."""
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out += words[k : k + size] * _TIMES[lane, k]
        return mix(out)


class _Words:
    """The words of some texts: their bytes, text numbers, places in their text, hashes."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = text_bytes(texts)
        self.start, self.end, self.text = words_of(self.data, self.offsets)
        self.upto = np.searchsorted(self.text, np.arange(len(texts) + 1))  # each text's first word
        self.place = np.arange(len(self.start)) - self.upto[self.text]
        self.size = np.diff(self.upto)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def inside(self, n: int) -> np.ndarray:
        """Whether ``n`` words from each place on lie in one text (for all places from which there are so many words)."""
        size = max(0, len(self.start) - n + 1)
        return self.place[:size] + n <= self.size[self.text[:size]]


def _is_in(values: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Whether each value is in ``kept``, which is sorted."""
    if not len(kept):
        return np.zeros(len(values), bool)
    return kept[np.minimum(np.searchsorted(kept, values), len(kept) - 1)] == values


def _anchors(frequent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(h, d, k, p, frequent): hash and place of each anchor on the cover. Frequent ones get a hash of their own."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value if frequent is not None else np.zeros(0, np.uint64)
        for batch in slices(batches, "text"):
            w = _Words(batch["text"])
            d, k = (batch[c].to_numpy().view(np.uint64) for c in ("d", "k"))
            whole = w.inside(ANCHOR)
            at = np.flatnonzero(whole & np.isin(w.place[: len(whole)] % PERIOD, COVER) & (w.size[w.text[: len(whole)]] >= WINDOW))
            h, text, place = _summed(w.hashes(), ANCHOR, 0)[at], w.text[at], w.place[at]
            many = _is_in(h, often)
            with np.errstate(over="ignore"):
                h[many] = mix(mix(d[text[many]] + k[text[many]]) + place[many].astype(np.uint64))
            yield pa.record_batch([pa.array(signed(x)) for x in (h, d[text], k[text])] + [pa.array(place.astype(np.int32)), pa.array(many)], names=["h", "d", "k", "p", "frequent"])

    return found


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    press = zstandard.ZstdCompressor(3)
    for batch in slices(batches, "text"):
        texts = [press.compress((t or "").encode()) for t in batch["text"].to_pylist()]
        yield pa.record_batch([batch["doc_id"], batch["d"], batch["k"], pa.array(texts, pa.binary())], names=["doc_id", "d", "k", "z"])


def _unpacked(z: pa.Array) -> pa.Array:
    open_ = zstandard.ZstdDecompressor()
    return pa.array([open_.decompress(x) for x in z.to_pylist()], pa.binary())


def _covered(places: np.ndarray, size: int, before: int, after: int) -> np.ndarray:
    """Which of ``size`` numbers lie between ``before`` below and ``after`` above one of ``places``."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, np.maximum(places - before, 0), 1)
    np.add.at(step, np.minimum(places + after + 1, size), -1)
    return np.cumsum(step[:-1]) > 0


def _flat(batch: pa.RecordBatch, column: str, w: _Words) -> np.ndarray:
    """A column of lists of places in each text, as places among all words."""
    lists = batch[column]
    counts = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(w.upto[:-1], counts)


def _windows(frequent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b, d, k, p, part): hashes and place of each window that holds a repeated anchor at one of its first PERIOD places; part 0: not frequent."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in slices(batches, "z", 1 << 18):
            w = _Words(_unpacked(batch["z"]))
            fits = w.inside(WINDOW)
            near = _covered(_flat(batch, "places", w), len(w.start), PERIOD - 1, 0)[: len(fits)]
            at = np.flatnonzero(fits & near)
            h = w.hashes()
            text = w.text[at]
            d, k = (batch[c].to_numpy()[text] for c in ("d", "k"))
            part = np.zeros(len(at), np.int32)
            if len(often):  # whether it holds a frequent anchor is told by the words alone, so alike for equal windows
                hot = np.concatenate([[0], np.cumsum(_is_in(_summed(h, ANCHOR, 0), often))])
                many = hot[at + PERIOD] > hot[at]
                part[many] = 1 + mix((d ^ k)[many].view(np.uint64)) % np.uint64(PARTS)
            a, b = signed(_summed(h, WINDOW, 1)[at]), (_summed(h, WINDOW, 2)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            columns = [a, b, d, k, w.place[at].astype(np.int32), part]
            yield pa.record_batch([pa.array(x) for x in columns], names=["a", "b", "d", "k", "p", "part"])

    return found


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words that a window in ``places`` covers; ``copy``: all windows do."""
    for batch in slices(batches, "z", 1 << 18):
        w = _Words(_unpacked(batch["z"]))
        gone = _covered(_flat(batch, "places", w), len(w.start), 0, WINDOW - 1) if len(w.start) else np.zeros(0, bool)
        copy = batch["copy"].to_numpy(zero_copy_only=False).astype(bool) & (w.size >= WINDOW)
        gone |= copy[w.text]
        texts, removed = [], np.zeros(len(w.size), np.int64)
        np.add.at(removed, w.text, gone)
        raw = w.data.tobytes()
        for i in range(batch.num_rows):
            own = np.arange(w.upto[i], w.upto[i + 1])
            own = own[~gone[own]]
            texts.append(b" ".join([raw[a:b] for a, b in zip(w.start[own].tolist(), w.end[own].tolist(), strict=True)]))
        yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(w.size.astype(np.int64)), pa.array(removed)], names=["doc_id", "text", "n_words", "n_removed"])


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with ``d``, which orders them, and ``k``, which tells apart rows that repeat an id."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeats = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    k = F.xxhash64(F.col("doc_id").isNull(), "text") if repeats else F.col("doc_id").isNull().cast("long")
    return own.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("d"), k.alias("k"), "text")


def _frequent(rows: DataFrame):
    """A broadcast array of the anchors that a sample shows often."""
    few = rows.where(F.pmod(F.xxhash64("k", "d"), F.lit(SAMPLED)) == 0).select("d", "k", "text")
    counts = few.mapInArrow(_anchors(None), "h long, d long, k long, p int, frequent boolean").groupBy("h").agg(F.count("*").alias("n"))
    top = counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(HOT).collect()
    return rows.sparkSession.sparkContext.broadcast(np.sort(np.array([r["h"] for r in top], np.int64).view(np.uint64)))


def _copies(rows: DataFrame) -> DataFrame:
    """Keys of the rows whose text occurs under a smaller id."""
    told = rows.where(F.length("text") > 0).select("d", "k", F.unhex(F.sha2("text", 256)).alias("digest"))
    first = told.groupBy("digest").agg(F.min("d").alias("first"), F.count("*").alias("n")).where("n > 1")
    both = spread_join(told, first.select("digest", "first"), "digest", "d", counts=first.select("digest", "n"))
    return both.where("d > first").select("d", "k").distinct()


def packed(rows: DataFrame) -> DataFrame:
    """(doc_id, d, k, z). The keys are declared as never null, else a join would filter them, and two joins not share a shuffle."""
    return rows.select("doc_id", "d", "k", "text").mapInArrow(_packed, StructType([StructField("doc_id", LongType()), StructField("d", LongType(), False), StructField("k", LongType(), False), StructField("z", BinaryType())]))


def repeated_windows(rows: DataFrame, frequent=None, copies: DataFrame | None = None) -> DataFrame:
    """(d, k, p): the windows of ``rows`` (d, k, text) that start earlier, too, but for those of ``copies``."""
    frequent = _frequent(rows) if frequent is None else frequent
    anchors = rows.select("d", "k", "text").mapInArrow(_anchors(frequent), "h long, d long, k long, p int, frequent boolean")
    met = anchors.withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("frequent or n > 1")
    places = met.groupBy("d", "k").agg(F.collect_set("p").alias("places"))
    if copies is not None:
        places = places.join(copies, ["d", "k"], "left_anti")
    windows = packed(rows).join(places, ["d", "k"]).mapInArrow(_windows(frequent), "a long, b int, d long, k long, p int, part int")
    # both uses of ``seen`` read one shuffle: they filter by what the window gives, and by no column that one of them lacks
    seen = windows.withColumn("later", _later("a", "b", "part"))
    later = seen.where("later").select("d", "k", "p")
    if len(frequent.value):
        first = seen.where(F.when(F.col("later"), F.lit(False)).otherwise(F.col("part") > 0))
        later = later.union(first.withColumn("later", _later("a", "b")).where("later").select("d", "k", "p"))
    return later


def _later(*keys: str) -> Column:
    """Whether a row isn't at the least place among those with its keys."""
    own = Window.partitionBy(*keys).orderBy("d", "p")  # of plain columns: a struct would be made, and shipped, before the shuffle
    return (F.first("d").over(own) < F.col("d")) | (F.first("p").over(own) < F.col("p"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text (the words that stay, joined by one space), n_words and n_removed of each row of ``docs``."""
    rows = _keyed(docs)
    copies = _copies(rows)
    # dealt first: sets made before the shuffle would hold a place or two each, and be larger than the rows
    gone = repeated_windows(rows, copies=copies).repartition("d", "k").groupBy("d", "k").agg(F.collect_set("p").alias("places"))
    told = gone.withColumn("copy", F.lit(False)).unionByName(copies.select("d", "k", F.array().cast("array<int>").alias("places"), F.lit(True).alias("copy")))
    both = packed(rows).join(told, ["d", "k"], "left")
    own = both.select("doc_id", "z", F.coalesce("places", F.array().cast("array<int>")).alias("places"), F.coalesce("copy", F.lit(False)).alias("copy"))
    return own.mapInArrow(_kept, "doc_id long, text string, n_words long, n_removed long")
