"""Whole texts to token ids, many texts of an Arrow batch at a time.

A byte-level BPE merges nothing across its pre-tokens (words with the space
before them, numbers, runs of punctuation, white space). For texts of ASCII and
Latin-1 letters their bounds are found with numpy, Arrow tells apart the distinct
pre-tokens of a batch, the tokenizers library encodes those not met before, and
the texts' ids are gathered from them. All other texts go to the library whole.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_bytes

LETTER, DIGIT, SPACE, OTHER, ODD = range(5)
KNOWN = 600_000  # pre-tokens that a worker keeps between batches at most, of some 200 bytes


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[[b for b in range(128) if chr(b).isalpha()]] = LETTER
    out[48:58] = DIGIT
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    out[[*range(9), *range(14, 32), 127, *range(128, 256)]] = ODD
    return out


_CLASS = _classes()


def _byte_letters() -> list[str]:
    """The printable letter by which a byte-level BPE writes each byte: itself, or else the next one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = itertools.count(256)
    return [chr(b if b in own else next(rest)) for b in range(256)]


_LETTERS = str.maketrans(dict(enumerate(_byte_letters())))


def gather(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``which`` of a ragged array (values, offsets), again as values and offsets."""
    size = offsets[which + 1] - offsets[which]
    out = np.zeros(len(which) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    at = np.repeat(offsets[which] - out[:-1], size) + np.arange(out[-1])
    return values[at], out


def classes_of(data: np.ndarray) -> np.ndarray:
    """A class for each byte; the two bytes of a Latin-1 letter count as letters, other non-ASCII bytes as ODD."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    lead = lead[(tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)]
    kind[lead] = LETTER
    kind[lead + 1] = LETTER
    return kind


def bounds_of(data: np.ndarray, kind: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, and the end, in texts without ODD bytes that begin at ``text_at``."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    white = kind == SPACE
    edge = np.zeros(n + 1, bool)
    edge[text_at] = True
    edge[n] = True
    # the last of white space before another character of the text stands alone, or joins it if it is a space
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~edge[1:n])
    cut[last] = True
    cut[last[data[last] == 32] + 1] = False
    # after a letter, digit or white space other than a space, an apostrophe begins 's 't 'm 'd 're 've 'll
    quote = np.flatnonzero(data == 39)
    if len(quote):
        pad = np.concatenate([data, np.zeros(2, np.uint8)])
        stop = np.concatenate([edge, np.ones(2, bool)])
        before = np.where(stop[quote], 10, pad[quote - 1])
        free = quote[stop[quote] | (kind[quote - 1] == LETTER) | (kind[quote - 1] == DIGIT) | ((kind[quote - 1] == SPACE) & (before != 32))]
        one, two = pad[free + 1], pad[free + 2]
        inside = ~stop[free + 1]
        short = free[inside & np.isin(one, np.frombuffer(b"stmd", np.uint8))]
        long = free[inside & ~stop[free + 2] & (((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108)))]
        for at, size in ((short, 2), (long, 3)):
            cut[at + 1] = False
            cut[at + size] = True
    cut |= edge
    return np.flatnonzero(cut)


class BatchEncoder:
    """``encode`` gives the ids that ``Tokenizer.encode(text, add_special_tokens=False)`` gives."""

    def __init__(self, path: str, known: int = KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.most = known
        self.known: dict[str, int] = {}
        self.values = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def keep(self, parts: list[str]) -> None:
        """Forgets all but those of ``parts`` that are known: what came up again, not what came once."""
        again = [p for p in parts if p in self.known]
        self.values, self.offsets = gather(self.values, self.offsets, np.fromiter(map(self.known.get, again), np.int64, len(again)))
        self.known = dict(zip(again, range(len(again)), strict=True))

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return _ragged(found)

    def learn(self, parts: list[str]) -> None:
        self.known.update(zip(parts, range(len(self.offsets) - 1, len(self.offsets) - 1 + len(parts)), strict=True))
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(p.encode().decode("latin-1").translate(_LETTERS))] for p in parts]
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(size)])
        self.values = np.concatenate([self.values, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(size.sum()))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), one after another, and n + 1 offsets."""
        texts = pc.fill_null(texts, "")
        data, at = text_bytes(texts)
        kind = classes_of(data) if len(data) else np.zeros(0, np.uint8)
        odd = np.diff(np.concatenate([[0], np.cumsum(kind == ODD)])[at]) > 0
        for mark in self.special:
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~odd)
        if len(plain) < len(texts):
            keep = np.repeat(~odd, np.diff(at))
            data, kind = data[keep], kind[keep]
            at = np.concatenate([[0], np.cumsum(np.diff(at)[plain])])
        if len(data):
            bounds = bounds_of(data, kind, at[:-1])
            spans = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
            coded = spans.dictionary_encode()
            names = coded.dictionary.to_pylist()
            if len(self.known) + len(names) > self.most:
                self.keep(names)
            row = np.fromiter(map(self.known.get, names, itertools.repeat(-1)), np.int64, len(names))
            new = np.flatnonzero(row < 0)
            if len(new):
                row[new] = np.arange(len(self.offsets) - 1, len(self.offsets) - 1 + len(new))
                self.learn([names[i] for i in new])
            ids, part_at = gather(self.values, self.offsets, row[np.asarray(coded.indices, np.int64)])
            ids_at = part_at[np.searchsorted(bounds, at)]
        else:
            ids, ids_at = np.zeros(0, np.int32), np.zeros(len(plain) + 1, np.int64)
        if len(plain) == len(texts):
            return ids, ids_at
        others, other_at = self.whole(texts.filter(pa.array(odd)).to_pylist())
        order = np.empty(len(texts), np.int64)
        order[plain] = np.arange(len(plain))
        order[odd] = len(plain) + np.arange(len(texts) - len(plain))
        return gather(np.concatenate([ids, others]), np.concatenate([ids_at, len(ids) + other_at[1:]]), order)


def _ragged(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros(len(found) + 1, np.int64)
    np.cumsum([len(x) for x in found], out=out[1:])
    return np.concatenate([np.zeros(0, np.int32), *found]), out


_encoders: dict[tuple[str, int], BatchEncoder] = {}


def encoder(path: str, known: int = KNOWN) -> BatchEncoder:
    """One per Python worker, kept from task to task."""
    if (path, known) not in _encoders:
        _encoders[path, known] = BatchEncoder(path, known)
    return _encoders[path, known]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
