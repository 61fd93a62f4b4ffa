"""Secrets in texts: patterns, and candidates confirmed by their structure.

Base spans are what three patterns find. A base64 or hex run that no pattern can tell
from noise is decoded and reported only if it parses: a private key in DER (its nested
lengths must fill their parents exactly), an OpenSSH key (length-prefixed
strings), a PEM block that holds one, a signed token whose header and claims are JSON
with an algorithm, or an encoded text that itself holds a base secret.

Spans are of code points, end exclusive. Null and empty texts have none; a null
doc_id stays null, repeated rows are scanned each by itself, extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Kinds in the order of spans that begin together.
KINDS = ("assign", "access", "hex", "pem", "jwt", "key", "encoded")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # the runs [0-9a-f]+ of 24 characters and more

PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
# the shortest base secret has 12 characters (token=abcdef)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++={0,2})+")
RUN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9a-f]{24,}|[0-9A-F]{24,})(?![0-9A-Fa-f])")


def decode64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if it is neither."""
    text = re.sub(r"\s+", "", text).rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def der(raw: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of consecutive DER elements that fill ``raw`` exactly; None if they don't."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, size, at = raw[at], raw[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(raw):
                return None
            size, at = int.from_bytes(raw[at : at + n], "big"), at + n
            if size < 128:
                return None  # not the shortest form
        if at + size > len(raw):
            return None
        out.append((tag, raw[at : at + size]))
        at += size
    return out


INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def is_private_key(raw: bytes) -> bool:
    """Whether the bytes are one private key: PKCS#1, PKCS#8 (also encrypted), SEC 1 or OpenSSH."""
    if raw.startswith(b"openssh-key-v1\0"):
        return _is_openssh(raw[15:])
    if len(raw) < 16 or raw[0] != SEQUENCE:
        return False
    top = der(raw)
    if top is None or len(top) != 1 or (parts := der(top[0][1])) is None:
        return False
    tags = [t for t, _ in parts]
    if len(tags) >= 9 and set(tags[:9]) == {INTEGER}:  # PKCS#1: version, modulus, exponents, primes
        return len(parts[1][1]) >= 32
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:  # PKCS#8
        inner = der(parts[1][1])
        return bool(inner) and inner[0][0] == OID and len(parts[2][1]) >= 16
    if tags[:2] == [SEQUENCE, OCTETS]:  # encrypted PKCS#8
        inner = der(parts[0][1])
        return len(tags) == 2 and bool(inner) and inner[0][0] == OID and len(parts[1][1]) >= 16
    return tags[:2] == [INTEGER, OCTETS] and parts[0][1] == b"\x01" and 20 <= len(parts[1][1]) <= 66  # SEC 1


def _is_openssh(raw: bytes) -> bool:
    """Cipher, kdf, its options, a count, public keys and the private part, each with its length."""
    at, fields = 0, 0
    while at + 4 <= len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        at += 4
        if fields == 3:  # the count of keys
            if not 1 <= size <= 16:
                return False
            fields += 1
            continue
        if at + size > len(raw):
            return False
        at, fields = at + size, fields + 1
    return at == len(raw) and fields >= 6


def is_signed_token(header: str, claims: str) -> bool:
    parts = []
    for x in (header, claims):
        raw = decode64(x)
        try:
            parts.append(json.loads(raw) if raw else None)
        except (UnicodeDecodeError, ValueError, RecursionError):
            return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def _holds_secret(raw: bytes) -> bool:
    try:
        text = raw.decode("ascii")
    except UnicodeDecodeError:
        return False
    return bool(text.isprintable() or "\n" in text) and (bool(base_spans(text)) or PEM.search(text) is not None)


def wrapped_runs(text: str) -> Iterator[tuple[int, int]]:
    """Spans of base64 over several lines: lines of one width, without and with the shorter line after them."""
    for m in WRAPPED.finditer(text):
        runs = [r.span() for r in RUN.finditer(text, m.start(), m.end())]
        first = 0
        while first < len(runs):
            width, last = runs[first][1] - runs[first][0], first
            while last + 1 < len(runs) and runs[last + 1][1] - runs[last + 1][0] == width:
                last += 1
            if width >= 16 and last > first:
                yield runs[first][0], runs[last][1]
            if width >= 16 and last + 1 < len(runs) and runs[last + 1][1] - runs[last + 1][0] < width:
                yield runs[first][0], runs[last + 1][1]
            first = last + 1


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    out, pem = [], []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            raw = decode64(m[2])
            if raw is not None and is_private_key(raw):
                out.append((*m.span(), "pem"))
                pem.append(m.span())
    tokens = []
    m = JWT.search(text)
    while m:
        if is_signed_token(m[1], m[2]):
            out.append((*m.span(), "jwt"))
            tokens.append(m.span())
            m = JWT.search(text, m.end())
        else:
            m = JWT.search(text, m.start(2))  # the next part may be the header
    known = pem + tokens
    for start, end in (*(m.span() for m in BASE64.finditer(text)), *wrapped_runs(text)):
        if any(a <= start and end <= b for a, b in known):
            continue
        raw = decode64(text[start:end])
        if raw is not None:
            if is_private_key(raw):
                out.append((start, end, "key"))
            elif _holds_secret(raw):
                out.append((start, end, "encoded"))
    for m in ANY_HEX.finditer(text):
        if (m.end() - m.start()) % 2 == 0:
            raw = bytes.fromhex(m[0])
            if is_private_key(raw):
                out.append((*m.span(), "key"))
            elif _holds_secret(raw):
                out.append((*m.span(), "encoded"))
    return out


_RANK = {k: i for i, k in enumerate(KINDS)}


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(set(spans), key=lambda s: (s[0], _RANK[s[2]], s[1]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start and end) of every row."""
    kind = "array<struct<kind:string,start:long,end:long>>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, "text"):
            base, both = [], []
            for text in batch["text"].to_pylist():
                own = base_spans(text or "")
                base.append([{"kind": k, "start": a, "end": b} for a, b, k in in_order(own)])
                both.append([{"kind": k, "start": a, "end": b} for a, b, k in in_order(own + confirmed_spans(text or ""))])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(base, span), pa.array(both, span)], ["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id long, base {kind}, spans {kind}")


def summarize(docs: DataFrame) -> DataFrame:
    """Counts by base kind, a digest of the base spans, and all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
