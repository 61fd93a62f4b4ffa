"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE`` words each, whole text), every
passage is encoded from its surface (shares of letter and punctuation classes, word
lengths, repetition), a gated attention weighs the encodings, and the weighted mean is
scored (Ilse, Tomczak and Welling, 2018). Encoder, attention and score are learned together from
document labels alone.

Learning uses whole bags of at most ``TRAIN_DOCS`` labelled documents, those with the smallest hashes, and of
no more of them than have ``TRAIN_PASSAGES`` passages together; scoring takes all passages of all
documents. Labels, lang, source and doc_id are never inputs.

Null and empty texts are one empty passage and get a score like all others. Labels that
are null are ignored, and of repeated labels of a document the lowest counts; without labels of both kinds
every score is 0.5. Of rows that repeat a labelled doc_id the text with the smallest hash is learned from. A null doc_id is
scored, never learned from. Repeated rows are scored each by
itself, and extra columns are ignored. An empty table gives no rows. Texts are worked on in slices; a very long one takes some
20 bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, slices, span_hashes, text_bytes, words_of

PASSAGE = 64
TRAIN_DOCS, TRAIN_PASSAGES = 4000, 400_000  # a passage takes 100 bytes of the driver
THRESHOLD = 0.3
UNITS, GATES, EPOCHS, BATCH, RATE = 24, 16, 40, 64, 0.01
PATIENCE, GAIN = 6, 1e-3  # epochs without a fall of the loss by so much end the learning
FOLDS = 5

_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"!?", b"#$%&*@^~", b"|", b"/\\_-=+", b"()[]{}<>", b"\"'`", bytes(range(128, 256)), b"\n", b" \t\r\x0b\x0c"]
_GROUP = np.full(256, len(_GROUPS), np.uint8)
for _k, _g in enumerate(_GROUPS):
    _GROUP[list(_g)] = _k


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of the text of each (in order, each text has one at least)."""
    data, at = text_bytes(texts)
    start, end, doc = words_of(data, at)
    n_docs = len(at) - 1
    per_doc = np.bincount(doc, minlength=n_docs)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    first = np.flatnonzero(inside % PASSAGE == 0)
    width = len(_GROUPS) + 12
    out = np.zeros((len(first), width), np.float32)
    if len(first):
        words = np.diff(np.append(first, len(doc))).astype(np.float64)
        lo, hi = start[first], np.append(end[first[1:] - 1], end[-1])
        size = np.maximum(1, hi - lo)
        # bytes by group: sums between the passages' ends
        edges = np.stack([lo, hi], axis=1).reshape(-1)
        group = np.append(_GROUP[data], np.uint8(255))
        for k in range(len(_GROUPS)):
            out[:, k] = np.add.reduceat(group == k, edges, dtype=np.int32)[::2] / size
        length = (end - start).astype(np.float64)
        h = span_hashes(data, start, end)
        same = [np.concatenate([np.zeros(min(k, len(h)), bool), (h[k:] == h[:-k]) & (doc[k:] == doc[:-k]) if len(h) > k else np.zeros(0, bool)]) for k in (1, 2)]
        number = np.repeat(np.arange(len(first)), words.astype(np.int64))
        order = np.lexsort((h, number))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (number[order][1:] != number[order][:-1])
        total = lambda x: np.add.reduceat(x.astype(np.float64), first)
        mean = total(length) / words
        tail, head = group[end - 1], group[start]
        k = len(_GROUPS)
        out[:, k] = np.log1p(words) / 4
        out[:, k + 1] = np.log1p(mean)
        out[:, k + 2] = np.log1p(np.sqrt(np.maximum(0, total(length**2) / words - mean**2)))
        out[:, k + 3] = np.log1p(np.maximum.reduceat(length, first))
        out[:, k + 4] = total(same[0]) / words
        out[:, k + 5] = total(same[1]) / words
        out[:, k + 6] = np.bincount(number[order][fresh], minlength=len(first)) / words
        out[:, k + 7] = total(head == 0) / words
        out[:, k + 8] = total((tail > 2) & (tail < 10)) / words
        out[:, k + 9] = total((tail > 3) & (tail < 10)) / words
        out[:, k + 10] = total(length <= 2) / words
        out[:, k + 11] = total((head > 2) & (head < 10)) / words
    empty = np.flatnonzero(per_doc == 0)
    if not len(empty):
        return out, doc[first]
    whose = np.concatenate([doc[first], empty])
    order = np.argsort(whose, kind="stable")
    return np.concatenate([out, np.zeros((len(empty), width), np.float32)])[order], whose[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Parameters by name, and how to scale features."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def score(self, x: np.ndarray, whose: np.ndarray) -> np.ndarray:
        """Scores of the bags that ``whose``, ascending, names."""
        e = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.p["w"] + self.p["b"])
        a = (np.tanh(e @ self.p["v"]) * _sigmoid(e @ self.p["u"])) @ self.p["a"]
        first = np.flatnonzero(np.diff(whose, prepend=-1))
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), np.diff(np.append(first, len(whose)))))
        z = np.add.reduceat(e * a[:, None], first) / np.add.reduceat(a, first)[:, None]
        return _sigmoid(z @ self.p["c"] + self.p["d"][0])


def loss_and_gradients(p: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss of bags (their passages one after another in ``x``, ``count`` of each) and its gradients."""
    first, bag = np.cumsum(count) - count, np.repeat(np.arange(len(count)), count)
    e = np.tanh(x @ p["w"] + p["b"])
    t, s = np.tanh(e @ p["v"]), _sigmoid(e @ p["u"])
    a = (t * s) @ p["a"]
    a = np.exp(a - np.maximum.reduceat(a, first)[bag])
    a /= np.add.reduceat(a, first)[bag]
    z = np.add.reduceat(a[:, None] * e, first)
    score = _sigmoid(z @ p["c"] + p["d"][0])
    loss = -np.mean(y * np.log(score + 1e-12) + (1 - y) * np.log(1 - score + 1e-12))
    dz = (score - y) / len(y)
    back = (dz[:, None] * p["c"])[bag]
    da = (back * e).sum(axis=1)
    dl = a * (da - np.add.reduceat(a * da, first)[bag])
    dt, ds = dl[:, None] * p["a"] * s * (1 - t * t), dl[:, None] * p["a"] * t * s * (1 - s)
    de = (a[:, None] * back + dt @ p["v"].T + ds @ p["u"].T) * (1 - e * e)
    return float(loss), {"c": z.T @ dz, "d": np.array([dz.sum()]), "a": (t * s).T @ dl, "v": e.T @ dt, "u": e.T @ ds, "w": x.T @ de, "b": de.sum(axis=0)}


def fit(x: np.ndarray, whose: np.ndarray, y: np.ndarray, seed: int = 7) -> Model | None:
    """Adam on the log loss, until it falls no more or ``EPOCHS`` are over. None without both labels."""
    if len(np.unique(y)) < 2:
        return None
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = np.clip((x - mean) / scale, -6, 6).astype(np.float64)
    d = x.shape[1]
    p = {"w": rng.normal(0, d**-0.5, (d, UNITS)), "b": np.zeros(UNITS), "v": rng.normal(0, UNITS**-0.5, (UNITS, GATES)), "u": rng.normal(0, UNITS**-0.5, (UNITS, GATES)), "a": rng.normal(0, GATES**-0.5, GATES), "c": rng.normal(0, UNITS**-0.5, UNITS), "d": np.zeros(1)}
    m, v2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    first = np.searchsorted(whose, np.arange(len(y)))
    count = np.diff(np.append(first, len(whose)))
    best, since = np.inf, 0
    for epoch in range(EPOCHS):
        rate, total = RATE * (1 - epoch / EPOCHS), 0.0
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            own = order[k : k + BATCH]
            n = count[own]
            rows = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            loss, g = loss_and_gradients(p, x[rows], n, y[own])
            total += loss * len(own) / len(y)
            step += 1
            for name, grad in g.items():
                grad = grad + 1e-4 * p[name]
                m[name] = 0.9 * m[name] + 0.1 * grad
                v2[name] = 0.999 * v2[name] + 0.001 * grad**2
                p[name] = p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v2[name] / (1 - 0.999**step)) + 1e-8)
        best, since = (total, 0) if total < best - GAIN else (best, since + 1)
        if since >= PATIENCE:
            break
    return Model(mean, scale, p)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by ``FOLDS``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _training_rows(labels: DataFrame) -> DataFrame:
    """doc_id and quality of at most TRAIN_DOCS documents, so they may be broadcast."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    rows = F.broadcast(_training_rows(labels).withColumnRenamed("doc_id", "labelled_id"))
    known = docs.select("doc_id", "text").join(rows, F.col("doc_id") == F.col("labelled_id")).withColumn("t", F.coalesce(F.xxhash64("text"), F.lit(0)))
    # one text of each document: at most TRAIN_DOCS rows
    one = F.broadcast(known.groupBy("doc_id").agg(F.min("t").alias("t")).withColumnsRenamed({"doc_id": "one_id", "t": "one_t"}))
    own = known.join(one, (F.col("doc_id") == F.col("one_id")) & (F.col("t") == F.col("one_t"))).select("doc_id", "text", "quality").dropDuplicates(["doc_id"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, whose = passages(batch["text"])
            at = np.searchsorted(whose, np.arange(batch.num_rows + 1))
            rows = [x[a:b].astype("<f4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["quality"].cast(pa.int32()), pa.array(np.diff(at)), pa.array(rows, pa.binary())], ["doc_id", "quality", "n", "x"])

    bags = held(own.mapInArrow(encode, "doc_id long, quality int, n long, x binary"))
    # whole bags in the sample's order, as many as fit: one that is too large is left out, not those after it
    sizes = bags.select("doc_id", "n").orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # TRAIN_DOCS rows of longs
    fits, room = [], TRAIN_PASSAGES
    for r in sizes:
        if r["n"] <= room:
            fits.append((r["doc_id"],))
            room -= r["n"]
    if not sizes:
        return None
    if not fits:
        raise ValueError(f"no labelled document has at most {TRAIN_PASSAGES} passages")
    found = sorted(bags.join(F.broadcast(docs.sparkSession.createDataFrame(fits, "doc_id long")), "doc_id").collect())
    x = [np.frombuffer(r.x, "<f4").reshape(-1, len(_GROUPS) + 12) for r in found]
    return fit(np.concatenate(x), np.repeat(np.arange(len(x)), [len(b) for b in x]), np.array([r.quality for r in found], np.float64))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            if model is None:
                s = np.full(batch.num_rows, 0.5)
            else:
                x, whose = passages(batch["text"])
                s = model.score(x, whose)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(s.astype(np.float64))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(rate, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, columns as they are, scored in one pass without a join."""
    model = train(docs, labels)
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            if model is not None:
                x, whose = passages(batch["text"])
                batch = batch.filter(pa.array(model.score(x, whose) >= THRESHOLD))
            yield batch

    return docs.mapInArrow(keep, schema)
