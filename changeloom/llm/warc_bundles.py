"""WARC archives in seekable Zstandard bundles.

Each task appends its pages' WARC records to a bundle: records are grouped into
frames of about ``FRAME`` bytes that decompress independently, and a footer in
the Zstandard seekable format (a skippable frame) tells every frame's compressed and
decompressed size. A table maps each record to bundle, frame and offset
inside the frame, so one record costs one seek and one frame.

Of records with equal payloads (of ``least_bytes`` at least) that with the smallest page_id is a
response, and the others revisit it. Null payloads are empty; rows that repeat the smallest page_id
are all responses; a null page_id never is the smallest unless all are null, and then
all are responses. Null urls are ``about:blank``; extra columns are ignored; an empty table gives no rows. A very long payload is a record, and
so a frame, of its own, which a worker holds a few times.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, held, is_small, new_folder, slices, spread_join

FRAME, LEVEL = 1 << 20, 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"  # pages have no time of capture
ENTRY = "page_id long, bundle string, frame long, offset long, length long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisits: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header, which tells the payload's length, and no payload."""
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in (url or "about:blank"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisits else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisits:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    own = record_id.removeprefix("<urn:page:").removesuffix(">")
    return None if own == "null" else int(own)


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of one record; lengths and digest must agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("no whole record here")
    http, _, payload = block.partition(b"\r\n\r\n")
    own = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    size = int(own["content-length"])
    if headers["warc-type"] == "response" and (len(payload) != size or headers["warc-payload-digest"] != f"sha1:{payload_digest(payload)}"):
        raise ValueError(f"the payload of {headers['warc-record-id']} was damaged")
    return {"headers": headers, "payload_bytes": size, "payload": payload}


class BundleWriter:
    """Appends records; memory holds one frame."""

    def __init__(self, sink):
        self.sink, self.frames, self.buffer, self.size = sink, [], [], 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, raw: bytes) -> tuple[int, int]:
        """Frame and offset of the record. A record lies in one frame, which it may fill alone."""
        if self.buffer and self.size + len(raw) > FRAME:
            self.flush()
        place = len(self.frames), self.size
        self.buffer.append(raw)
        self.size += len(raw)
        return place

    def flush(self) -> None:
        if self.buffer:
            packed = self.compressor.compress(b"".join(self.buffer))
            self.sink.write(packed)
            self.frames.append((len(packed), self.size))
            self.buffer, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Bundle:
    """Reads single frames by the footer's seek table; keeps the last one."""

    def __init__(self, source):
        self.source, self.kept = source, (-1, b"")
        end = source.size()
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags & 0x80:
            raise ValueError("no seek table")
        source.seek(end - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", source.read(8 * n)))
        self.places, at = [], 0
        for packed, plain in sizes:
            self.places.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        if self.kept[0] != number:
            at, packed, plain = self.places[number]
            self.source.seek(at)
            self.kept = number, zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)
        return self.kept[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def with_responses(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (bytes), digest (hex), and the page to which equal payloads refer.

    First a narrow pass finds payloads that occur more than once (grouped minima, so a payload
    in very many pages is no hot group). Up to a counted bound these are broadcast, and pages aren't shuffled at all; beyond it pages
    are joined with them by digest, the pages of a common payload dealt to several tasks.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("bytes", F.length("payload"))
    often = own.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    often = held(often)
    first = often.select("digest", "bytes", "first")
    key = ["digest", "bytes"]
    joined = own.join(F.broadcast(first), key, "left") if is_small(often, BROADCAST_ROWS) else spread_join(own, first, key, "page_id", "left", often.select(*key, "n"))
    return joined.select("page_id", "url", "payload", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record per page; page_id, bundle, frame, offset and length of each.

    Bundles are named by attempt, and only those of successful tasks get into the
    table, which is kept in the shared folder: a lost executor costs a repeat, no more.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, sink, writer = f"{base}/pages-{uuid.uuid4().hex}.warc.zst", None, None
        try:
            for batch in slices(batches, "payload"):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(name, compression=None)
                    writer = BundleWriter(sink)
                entries = []
                columns = (batch[c].to_pylist() for c in ("page_id", "url", "payload", "refers_to"))
                for page_id, url, payload, refers_to in zip(*columns, strict=True):
                    raw = record(page_id, url, payload, payload_digest(payload), refers_to, refers_to is not None)
                    entries.append((*writer.add(raw), len(raw)))
                frame, offset, length = zip(*entries, strict=True)
                yield pa.RecordBatch.from_arrays([batch["page_id"].cast(pa.int64()), pa.array([name] * len(entries)), pa.array(frame, pa.int64()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["page_id", "bundle", "frame", "offset", "length"])
            if writer is not None:
                writer.close()
        finally:
            if sink is not None:
                sink.close()

    return held(with_responses(pages, least_bytes).mapInArrow(write, ENTRY))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Reads the indexed records back from the bundles, each by its frame."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        name, source, bundle = None, None, None
        try:
            for batch in batches:
                out = []
                for own, frame, offset, length in zip(*(batch[c].to_pylist() for c in ("bundle", "frame", "offset", "length")), strict=True):
                    if own != name:
                        if source is not None:
                            source.close()
                        name, source = own, store.open_input_file(own)
                        bundle = Bundle(source)
                    r = parse(bundle.record(frame, offset, length))
                    h = r["headers"]
                    refers = h.get("warc-refers-to")
                    out.append((_page_id(h["warc-record-id"]), r["payload_bytes"], h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], None if refers is None else _page_id(refers), h["warc-target-uri"], own.rsplit("/", 1)[1], frame, offset))
                if out:
                    f = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "bundle", "frame", "frame_offset"])
                    yield pa.RecordBatch.from_pandas(f.astype({"page_id": "Int64", "refers_to": "Int64"}), preserve_index=False)
        finally:
            if source is not None:
                source.close()

    return index.mapInArrow(load, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, bundle string, frame long, frame_offset long")


def archive(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the bundles and reads every record back. The table's order keeps records of a frame together."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return read_records(write_bundles(pages, folder, least_bytes), folder)
