"""Sequence packing: shortest pack first over the histogram of lengths.

Every document is cut into pieces of the sequence length and one remainder.
The histogram of the pieces' lengths (at most ``sequence_length`` numbers,
whatever the corpus) goes to the driver, which places lengths longest first,
always into the packs with most room, and counts how often each pattern of
lengths occurs. Pieces then find their place by their rank among the
pieces of their length: no task sees more than its own rows.

Null texts are empty (only the end id); a null doc_id stays null; repeated rows
are packed each by itself; an empty table gives no rows; extra columns are ignored. A very long text is encoded as a whole and gives
as many full pieces as it needs.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, slices
from .tokens import default_tokenizer, encoder

KNOWN = 200_000  # pre-tokens that a worker keeps: a third more work for the tokenizer than with 600,000, but some 70 MB less
RANKED = 2000  # pieces of one length that a task ranks, about
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ragged ids with ``end_id`` after each row."""
    n = len(at) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[at[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, at + np.arange(n + 1)


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, sequence_length: int = 2048, with_ids: bool = False) -> DataFrame:
    """The pieces of every document (and their ids, as an array, if asked for)."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, at = with_end(*encoder(path, KNOWN).encode(batch["text"]), end_id)
            size = np.diff(at)
            n = -(-size // sequence_length)
            row = np.repeat(np.arange(len(size)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * sequence_length
            length = np.minimum(sequence_length, size[row] - start)
            begin = at[row] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            columns = [batch["doc_id"].cast(pa.int64()).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[row])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, at[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE + (", ids array<int>" if with_ids else ""))


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, how many such packs), the lengths placed longest first into the packs with most room."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by the room left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed: list[tuple[int, tuple[int, ...], int]] = []
        for room in sorted((r for r in open_packs if r >= length), reverse=True):
            while left and open_packs[room]:
                pack, count = open_packs[room].pop()
                used = min(count, left)
                if count > used:
                    open_packs[room].append((pack, count - used))
                placed.append((room - length, (*pack, length), used))
                left -= used
            if not left:
                break
        # packs that took one piece may take another of the same length
        while placed:
            room, pack, count = placed.pop()
            used = min(count, left) if room >= length else 0
            if used:
                left -= used
                placed.append((room - length, (*pack, length), used))
            if count > used:
                open_packs[room].append((pack, count - used))
        fit = capacity // length
        if full := left // fit:
            open_packs[capacity - fit * length].append(((length,) * fit, full))
        if rest := left % fit:
            open_packs[capacity - rest * length].append(((length,) * rest, 1))
    return [x for room in sorted(open_packs) for x in open_packs[room]]


class Places:
    """Sequence and offset of the r-th piece of each length, from the patterns' counts."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        upto: dict[int, int] = defaultdict(int)
        sequence = 0
        for pack, count in patterns:
            offset = 0
            for length in pack:
                rows[length].append((upto[length], sequence, offset))
                upto[length] += count
                offset += length
            sequence += count
        self.by_length = {k: np.array(v, np.int64).T for k, v in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for n in np.unique(length):
            own = length == n
            first, base, at = self.by_length[int(n)]
            k = np.searchsorted(first, rank[own], side="right") - 1
            sequence[own] = base[k] + rank[own] - first[k]
            offset[own] = at[k]
        return sequence, offset


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, sequence_length: int = 2048, with_ids: bool = False) -> DataFrame:
    """All pieces with sequence_id and offset (and ids). Sequences are gapless from offset 0."""
    spark = docs.sparkSession
    found = held(pieces(docs, tokenizer, end_id, sequence_length, with_ids))
    # at most sequence_length rows
    histogram = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(shortest_pack_first(histogram, sequence_length)))
    # pieces of a length are dealt to so many parts that no part is large; a part's ranks start from the parts before
    total, top = sum(histogram.values()), max(histogram.values(), default=0)
    salts = max(1, -(-top // max(RANKED, total // 100_000)))
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    upto = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = found.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    # hashed by the same key as the window, so that the join needs no shuffle of its own
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = found.withColumn("rank", rank - 1).join(before, ["length", "salt"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("long"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.find(batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = [c.split()[0] for c in PIECE.split(", ")] + (["ids"] if with_ids else [])
    return ranked.select(*names, "rank").mapInArrow(place, PIECE + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long")
