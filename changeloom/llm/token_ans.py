"""Token files in a static range asymmetric numeral system.

A file is a run of segments. A segment holds up to ``SEGMENT`` ids: one
frequency table that all its blocks share, then independent blocks of ``BLOCK``
ids, each encoded by ``LANES`` interleaved coders (id i of a block by coder
i mod LANES). A block begins with its checkpoint: the coders' states and word
counts; the footer has every block's place, length and crc32, so that any block
can be decoded by itself. Documents are found by the footer's index of
doc_id and length.

    magic | segments: table, blocks | footer (Arrow and JSON, deflated) | footer's length, magic

Null texts are empty (only the end id). Rows with a null doc_id come first,
and rows that share a doc_id follow each other, in the order of their texts' hashes. An empty table gives no file
and no rows; extra columns are ignored. A very long text is encoded as a whole and lies in as many segments as it needs.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, new_folder, slices
from .packing import with_end
from .tokens import default_tokenizer, encoder

MAGIC = b"CLRANS01"
LANES, BLOCK, SEGMENT = 32, 1 << 16, 1 << 22
PART, ROWS = 1 << 20, 8192  # ids decoded, rows returned at a time
BITS = 20  # frequencies add up to 2**BITS
LOW = np.uint64(1 << 31)  # states lie in [2**31, 2**63)
_WORD, _TOTAL = np.uint64(32), np.uint64(BITS)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur, and their frequencies: at least 1, in sum 2**BITS."""
    count = np.bincount(ids)
    symbols = np.flatnonzero(count)
    share = np.maximum(1, (count[symbols] * (1 << BITS)) // count.sum())
    over = int(share.sum()) - (1 << BITS)
    order = np.argsort(-share, kind="stable")
    if over <= 0:
        share[order[0]] -= over
    for k in order:  # rare ids were rounded up: the frequent ones give
        if over <= 0:
            break
        give = min(over, int(share[k]) // 2)
        share[k] -= give
        over -= give
    return symbols.astype(np.uint32), share.astype(np.uint32)


class Table:
    """Symbols by dense number, with frequencies and their running sums."""

    def __init__(self, symbols: np.ndarray, share: np.ndarray):
        self.symbols, self.share = symbols, share
        self.f = share.astype(np.uint64)
        self.c = np.concatenate([[0], np.cumsum(share, dtype=np.uint64)[:-1]]).astype(np.uint64)

    def pack(self) -> bytes:
        return zlib.compress(np.diff(self.symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + self.share.astype("<u4").tobytes(), 6)

    @classmethod
    def unpack(cls, raw: bytes) -> Table:
        a, b = np.frombuffer(zlib.decompress(raw), "<u4").reshape(2, -1)
        return cls(np.cumsum(a, dtype=np.uint32), b.astype(np.uint32))

    def encode(self, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States, word counts and words (row by row) of coders, one per column of ``dense``."""
        steps, width = dense.shape
        x = np.full(width, LOW, np.uint64)
        words, n = np.empty((steps + 1, width), np.uint32), np.zeros(width, np.int64)
        most = self.f << np.uint64(63 - BITS)
        for row in dense[::-1]:
            f = self.f[row]
            full = np.flatnonzero(x >= most[row])
            words[n[full], full] = x[full].astype(np.uint32)
            n[full] += 1
            x[full] >>= _WORD
            q = x // f
            x = (q << _TOTAL) + (x - q * f) + self.c[row]
        return x, n, words

    def decode(self, x: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
        """Ids, one column per coder; ``at``: where each coder's words begin."""
        of_slot = np.repeat(np.arange(len(self.f), dtype=np.uint32), self.share)
        x, at = x.copy(), at.copy()
        words = np.append(words, np.uint32(0))
        out = np.empty((steps, len(x)), np.uint32)
        mask = np.uint64((1 << BITS) - 1)
        for k in range(steps):
            slot = x & mask
            row = of_slot[slot]
            out[k] = row
            x = self.f[row] * (x >> _TOTAL) + slot - self.c[row]
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << _WORD) | words[at[low]]
            at[low] += 1
        return self.symbols[out]


def encode_segment(ids: np.ndarray) -> tuple[bytes, list[bytes], list[int]]:
    """The shared table, the blocks, and the blocks' numbers of ids."""
    table = Table(*frequencies(ids))
    dense = np.searchsorted(table.symbols, ids).astype(np.uint32)
    full = len(ids) // BLOCK * BLOCK
    blocks, sizes = [], []
    for part, count in ((dense[:full], full // BLOCK), (dense[full:], 1)):
        if not len(part):
            continue
        size = len(part) // count
        steps = -(-size // LANES)
        part = np.append(part, np.zeros(steps * LANES * count - len(part), np.uint32))
        x, n, words = table.encode(np.ascontiguousarray(part.reshape(count, steps, LANES).transpose(1, 0, 2).reshape(steps, -1)))
        for b in range(count):
            own = slice(b * LANES, (b + 1) * LANES)
            stream = [words[: n[k], k][::-1] for k in range(own.start, own.stop)]
            blocks.append(x[own].astype("<u8").tobytes() + n[own].astype("<u4").tobytes() + np.concatenate(stream).astype("<u4").tobytes())
            sizes.append(size)
    return table.pack(), blocks, sizes


def decode_blocks(table: bytes, blocks: list[bytes], sizes: list[int]) -> np.ndarray:
    """Ids of consecutive blocks of a segment (those of equal length at once)."""
    coder, out, k = Table.unpack(table), [], 0
    while k < len(blocks):
        end = k
        while end < len(blocks) and sizes[end] == sizes[k]:
            end += 1
        own, steps = blocks[k:end], -(-sizes[k] // LANES)
        x = np.concatenate([np.frombuffer(b, "<u8", LANES) for b in own]).astype(np.uint64)
        n = np.concatenate([np.frombuffer(b, "<u4", LANES, 8 * LANES) for b in own]).astype(np.int64)
        words = np.concatenate([np.frombuffer(b, "<u4", -1, 12 * LANES) for b in own])
        ids = coder.decode(x, words, np.cumsum(n) - n, steps).reshape(steps, len(own), LANES).transpose(1, 0, 2).reshape(len(own), -1)
        out.append(ids[:, : sizes[k]].reshape(-1))
        k = end
    return np.concatenate([np.zeros(0, np.uint32), *out])


class TokenFileWriter:
    """Appends documents' ids; memory holds one segment."""

    def __init__(self, sink):
        self.sink, self.at, self.waiting, self.n = sink, 0, [], 0
        self.segments, self.ids, self.sizes = [], [], []
        self.put(MAGIC)

    def put(self, raw: bytes) -> tuple[int, int]:
        self.sink.write(raw)
        self.at += len(raw)
        return self.at - len(raw), len(raw)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids.append(doc_ids)
        self.sizes.append(sizes)
        self.waiting.append(ids)
        self.n += len(ids)
        if self.n >= SEGMENT:
            self.flush(whole_only=True)

    def flush(self, whole_only: bool = False) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.waiting])
        end = len(ids) // SEGMENT * SEGMENT if whole_only else len(ids)
        for k in range(0, end, SEGMENT):
            table, blocks, sizes = encode_segment(ids[k : min(end, k + SEGMENT)])
            self.segments.append({"table": self.put(table), "blocks": [[*self.put(b), n, zlib.crc32(b)] for b, n in zip(blocks, sizes, strict=True)]})
        self.waiting, self.n = [ids[end:]], len(ids) - end

    def close(self) -> tuple[int, int]:
        self.flush()
        index = pa.table({"doc_id": pa.chunked_array(self.ids, pa.int64()), "n": pa.array(np.concatenate([np.zeros(0, np.int64), *self.sizes]))})
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, index.schema) as w:
            w.write_table(index)
        parts = [zlib.compress(out.getvalue().to_pybytes(), 1), zlib.compress(json.dumps(self.segments).encode())]
        for p in parts:
            self.put(p)
        self.put(struct.pack("<QQ", *map(len, parts)) + MAGIC)
        return index.num_rows, int(sum(x.sum() for x in self.sizes))


class TokenFile:
    """Random access to a file: ``blocks`` decodes any blocks of a segment; checksums are compared."""

    def __init__(self, source):
        self.source = source
        tail = self.bytes(source.size() - 24, 24)
        if tail[16:] != MAGIC:
            raise ValueError("no token file, or cut short")
        a, b = struct.unpack("<QQ", tail[:16])
        self.segments = json.loads(zlib.decompress(self.bytes(source.size() - 24 - b, b)))
        index = zlib.decompress(self.bytes(source.size() - 24 - b - a, a))
        self.index = pa.ipc.open_stream(index).read_all()

    def bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def blocks(self, segment: int, first: int = 0, last: int | None = None) -> np.ndarray:
        s = self.segments[segment]
        own = s["blocks"][first:last]
        raw = [self.bytes(at, n) for at, n, _, _ in own]
        if any(zlib.crc32(r) != x[3] for r, x in zip(raw, own, strict=True)):
            raise ValueError(f"checksum of a block of segment {segment} differs")
        return decode_blocks(self.bytes(*s["table"]), raw, [x[2] for x in own])

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids from ``first`` to ``last`` (not itself) of the file, by the blocks that hold them."""
        out = [np.zeros(0, np.uint32)]
        for segment in range(first // SEGMENT, -(-last // SEGMENT)):
            lo, hi = max(0, first - segment * SEGMENT), min(SEGMENT, last - segment * SEGMENT)
            out.append(self.blocks(segment, lo // BLOCK, -(-hi // BLOCK))[lo - lo // BLOCK * BLOCK :][: hi - lo])
        return np.concatenate(out)

    def documents(self, segment: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of the documents that begin in a segment (None: of all), some blocks at a time."""
        n = self.index["n"].to_numpy()
        start = np.cumsum(n) - n
        lo, hi = (0, len(n)) if segment is None else np.searchsorted(start, [segment * SEGMENT, (segment + 1) * SEGMENT])
        while lo < hi:
            end = max(lo + 1, int(np.searchsorted(start[:hi], start[lo] + PART, side="left")))
            found = self.ids(int(start[lo]), int(start[end - 1] + n[end - 1]))
            for k, doc_id in enumerate(self.index["doc_id"].slice(lo, end - lo).to_pylist(), start=int(lo)):
                yield doc_id, int(start[k]), found[start[k] - start[lo] :][: n[k]]
            lo = end


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0) -> list[tuple[int, str, int, int]]:
    """Writes all documents in ascending doc_id order, a file for each range of ids.

    Returns (number, path, documents, ids) of each file, which only tells of files: as many as partitions.
    A file is named by its attempt, and only what a successful task has named is read,
    so lost executors leave no harm. Rows of one doc_id may lie in several ranges, so no doc_id is a hot key.
    """
    path = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        number = TaskContext.get().partitionId()
        name = f"{base}/ids-{number:06d}-{uuid.uuid4().hex}.rans"
        writer = sink = None
        try:
            for batch in slices(batches, "text", 4 << 20):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(name, compression=None)
                    writer = TokenFileWriter(sink)
                ids, at = with_end(*encoder(path).encode(batch["text"]), end_id)
                writer.add(batch["doc_id"].cast(pa.int64()), ids, np.diff(at))
            if writer is not None:
                rows, n = writer.close()
                yield pa.RecordBatch.from_pydict({"number": [number], "path": [name], "rows": [rows], "ids": [n]})
        finally:
            if sink is not None:
                sink.close()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    done = held(ordered.mapInArrow(write, "number long, path string, rows long, ids long"))
    return sorted(tuple(r) for r in done.collect())


def read_token_files(spark: SparkSession, folder: str, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file and start_in_file of every document, decoded from the files, a segment a row of work."""
    rows, before = [], 0
    for _, path, _, n in files:
        rows += [(path, before, segment) for segment in range(-(-n // SEGMENT))]
        before += n
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string, start_in_file long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)

        def rows_of(out: list[tuple], name: str) -> pa.RecordBatch:
            doc_id, start, n, crc, at = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array([name] * len(out)), pa.array(at, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32", "file", "start_in_file"])

        for batch in batches:
            for path, base, segment in zip(*(batch[c].to_pylist() for c in ("path", "before", "segment")), strict=True):
                out, name = [], path.rsplit("/", 1)[1]
                with store.open_input_file(path) as source:
                    for doc_id, at, ids in TokenFile(source).documents(segment):
                        out.append((doc_id, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), at))
                        if len(out) == ROWS:
                            yield rows_of(out, name)
                            out = []
                if out:
                    yield rows_of(out, name)

    # dealt in turn, not by a hash, so that tasks have equal shares
    table = spark.createDataFrame(rows, "path string, before long, segment long").repartition(len(rows))
    return table.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, start_in_file long")


def encode_corpus(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the token files and reads them back: a row per document."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, folder, tokenizer, end_id))
