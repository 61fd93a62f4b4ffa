"""Near-duplicate documents by a multi-index Hamming join of minhash signatures.

A document is the set of its distinct word shingles. Its signature has
``SYMBOLS`` minhashes cut to ``BITS`` bits each, in ``CHUNKS`` chunks. Two signatures
that differ in at most ``DISTANCE`` symbols have, by the pigeonhole principle, a
chunk with at most ``DISTANCE // CHUNKS`` differences; so every chunk is entered
once for each choice of that many symbols to leave out, and every pair within
the distance meets under an equal key. (At similarity 0.75 a signature differs
in 16 of 64 symbols on average; more than 31 has a chance of some 1e-5.)

What meets is confirmed on the full sets. Documents with equal sets are one class
first. Within a key no pairs are made at first: members are compared with the
heaviest there, which shares most keys with others. Members of a key that still lie in different
components are tested for the distance of their signatures, block by block in numpy; what is within it
is compared on full sets, again in blocks, so that no link between components is lost and only links are rows.

Rows with null or empty texts, or texts of white space, have an empty set and are
linked with nothing; an empty table gives no rows. Very long texts are worked on in windows of bytes; their
shingle set (8 bytes a shingle) is one value. Rows that repeat a doc_id are compared each by itself. A
null doc_id is never the smallest; a component of null ids alone has a null
component_id and its rows are kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, held, mix, signed, slices, span_hashes, spread_join, text_bytes, words_of
from .components import connected_components

SYMBOLS, BITS, CHUNKS, DISTANCE = 64, 16, 16, 31
WORDS, PERCENT = 5, 75
KEYS_BROADCAST = 500_000  # of two longs each, some 30 MB; what joins with them is the largest table here
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20  # nodes (and their shingles) compared with as many at a time
EDGES = 1 << 18  # edges that a task holds before it cuts them down to trees

_ODD = mix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)
_SEED, _TIMES = mix(np.arange(100, 100 + SYMBOLS, dtype=np.uint64)), mix(np.arange(300, 300 + SYMBOLS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts, one after another, and n + 1 offsets.

    A text with fewer words has one shingle of them all.
    """
    data, at = text_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    start, end, doc = words_of(data, at)
    w = span_hashes(data, start, end)
    per_doc = np.bincount(doc, minlength=len(at) - 1)
    first = np.cumsum(per_doc) - per_doc
    with np.errstate(over="ignore"):
        n = max(0, len(w) - words + 1)
        total = np.zeros(n, np.uint64)
        for k in range(words):
            total += w[k : k + n] * _ODD[k]
        ok = doc[:n] == doc[words - 1 : words - 1 + n]
        full, full_doc = mix(total[ok]), doc[:n][ok]
        few = np.flatnonzero((per_doc > 0) & (per_doc < words))
        short = np.zeros(len(few), np.uint64)
        for k in range(words - 1):
            has = per_doc[few] > k
            short[has] += w[first[few[has]] + k] * _ODD[k]
        short = mix(short + per_doc[few].astype(np.uint64))
    size = np.maximum(per_doc - words + 1, 0)
    size[few] = 1
    bounds = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(bounds[-1], np.uint64)
    long_doc = per_doc >= words
    out[np.repeat(long_doc, size)] = full
    out[bounds[few]] = short
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[bounds[:-1][size > 0]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def set_hashes(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, the same whatever its order (0: empty)."""
    some = np.flatnonzero(np.diff(at))
    one, two = np.zeros(len(at) - 1, np.uint64), np.zeros(len(at) - 1, np.uint64)
    if len(some):
        with np.errstate(over="ignore"):
            one[some] = np.add.reduceat(mix(values), at[some])
            two[some] = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), at[some])
    return one, two


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The symbols of each set (a row of zeros for an empty one)."""
    some = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, SYMBOLS), np.uint16)
    if len(some):
        with np.errstate(over="ignore"):
            for k in range(SYMBOLS):
                out[some, k] = (mix(np.minimum.reduceat((values + _SEED[k]) * _TIMES[k], at[some])) >> np.uint64(64 - BITS)).astype(np.uint16)
    return out


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """A row of keys for each signature: each chunk without each choice of symbols that may differ there."""
    width, errors = symbols.shape[1] // CHUNKS, DISTANCE // CHUNKS
    keys = []
    with np.errstate(over="ignore"):
        for chunk in range(CHUNKS):
            own = symbols[:, chunk * width : (chunk + 1) * width].astype(np.uint64)
            for number, keep in enumerate(combinations(range(width), width - errors)):
                total = np.full(len(own), chunk * 1000 + number, np.uint64)
                for k in keep:
                    total = mix(total * _ODD[k] + own[:, k])
                keys.append(total)
    return np.stack(keys, axis=1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        values, at = shingle_sets(batch["text"])
        one, two = set_hashes(values, at)
        symbols = signatures(values, at)
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SYMBOLS * 2), len(symbols), [None, pa.py_buffer(symbols.astype("<u2").tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["t"], pa.array(np.diff(at)), pa.array(signed(one)), pa.array(signed(two)), raw], ["doc_id", "t", "n_shingles", "s1", "s2", "symbols"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        values, at = shingle_sets(batch["text"])
        one, two = set_hashes(values, at)
        yield pa.RecordBatch.from_arrays([pa.array(np.diff(at)), pa.array(signed(one)), pa.array(signed(two)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(signed(values)))], ["n_shingles", "s1", "s2", "shingles"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            data, _ = text_bytes(batch["symbols"])
            keys = chunk_keys(data.view("<u2").reshape(-1, SYMBOLS))
            row = np.repeat(np.arange(batch.num_rows), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys.reshape(-1))), batch["node"].take(pa.array(row)), batch["n_shingles"].take(pa.array(row))], ["key", "node", "n_shingles"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    return _rows(docs).drop("t")


def _rows(docs: DataFrame) -> DataFrame:
    """What ``near_duplicates`` tells of each row, and t, the hash of its text."""
    docs = docs.select("doc_id", "text")
    signed_docs = docs.withColumn("t", F.xxhash64("text")).mapInArrow(_sign, "doc_id long, t long, n_shingles long, s1 long, s2 long, symbols binary")
    rows = held(signed_docs.withColumn("row", F.monotonically_increasing_id()))
    same = ["s1", "s2", "n_shingles"]
    classes = held(rows.where("n_shingles > 0").groupBy(*same).agg(F.min(F.struct("row", "symbols", "doc_id")).alias("first"), F.min("doc_id").alias("least")).select(*same, F.col("first.row").alias("node"), F.col("first.symbols").alias("symbols"), F.col("first.doc_id").alias("doc_id"), "least"))
    roots, merged = _components(docs, classes)
    own = classes.join(bounded_broadcast(roots), "node", "left").select(*same, "least", F.coalesce("root", "node").alias("label"))
    own = own.join(bounded_broadcast(merged).withColumnRenamed("root", "top"), F.col("label") == F.col("node"), "left").select(*same, "least", F.coalesce("top", "label").alias("root"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = own.join(least, "root").select(*same, "component_id")
    out = rows.join(named, same, "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "t", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def _components(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root) of classes that are linked, and (node, root) of those roots that further links merge."""
    keys = classes.select("node", "symbols", "n_shingles").mapInArrow(_keys, "key long, node long, n_shingles long")
    # tables of a few longs a row are broadcast up to a counted bound, and shuffled beyond it
    few = lambda df: bounded_broadcast(held(df))
    shared = held(keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    met = held(keys.join(bounded_broadcast(shared, KEYS_BROADCAST), "key"))
    nodes = few(met.groupBy("node").agg(F.sum("members").alias("weight")))
    met = met.join(nodes, "node").select("key", "node", "n_shingles", "weight")
    wanted = held(classes.join(nodes, "node", "left_semi").select("s1", "s2", "n_shingles", "node", "doc_id", "symbols"))
    ids = few(wanted.select(F.col("doc_id").alias("wanted")).distinct())
    sets = docs.join(ids, docs["doc_id"].eqNullSafe(ids["wanted"]), "left_semi").mapInArrow(_sets, "n_shingles long, s1 long, s2 long, shingles array<long>")
    sets = held(sets.join(bounded_broadcast(wanted.select("s1", "s2", "n_shingles", "node")), ["s1", "s2", "n_shingles"]).dropDuplicates(["node"]).select("node", "shingles"))

    # each node with the heaviest one that it meets: in a group of near copies mostly their common source
    best = few(met.groupBy("key").agg(F.max(F.struct("weight", "node", "n_shingles")).alias("best")))
    likely = 100 * F.least("n_shingles", "best.n_shingles") >= PERCENT * F.greatest("n_shingles", "best.n_shingles")
    pairs = met.join(best, "key").where((F.col("node") != F.col("best.node")) & likely).groupBy("node").agg(F.max("best").alias("best"))
    pairs = held(pairs.select(F.col("node").alias("a"), F.col("best.node").alias("b")))
    # a has one pair, but very many may have the same b
    both = spread_join(pairs, sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b", "a", narrow=True).join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a")
    common = F.size(F.array_intersect("x", "y"))
    linked = both.where(100 * common >= PERCENT * (F.size("x") + F.size("y") - common)).select("a", "b")
    roots = held(connected_components(linked))
    labelled = held(met.join(bounded_broadcast(roots), "node", "left").select("key", "node", F.coalesce("root", "node").alias("label")))
    several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    close = _close_nodes(labelled.join(few(several), "key"), wanted.select("node", "n_shingles", "symbols"))
    labels = few(labelled.select("node", "label").distinct())
    return roots, held(connected_components(_between(close, labels, sets)))


def _close_nodes(apart: DataFrame, signatures: DataFrame) -> DataFrame:
    """(node, cluster): nodes of different labels within the distance of one another, joined to clusters.

    ``apart`` has key, node, label and n, the members of the key. A key's members are dealt to blocks of ``BLOCK``, and
    each pair of blocks is a part of a task of its own, so that a hot key is no hot task.
    """
    parts = F.ceil(F.col("n") / BLOCK)
    dealt = apart.join(signatures, "node").withColumn("own", F.pmod(F.xxhash64("node"), parts))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "label", "n_shingles", "symbols")
    group = ["key", "x", "y"]
    near = held(dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_within, "a long, b long").distinct())
    return held(connected_components(near).withColumnRenamed("root", "cluster"))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a tree for each component of the edges given: no more of them than nodes."""
    names, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = both[: len(a)], both[len(a) :]
    root = np.arange(len(names))
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    tied = np.flatnonzero(root != np.arange(len(root)))
    return names[tied], names[root[tied]]


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect what is within the distance, of rows in order of their groups (key, x, y)."""
    names, rest = ["key", "x", "y", "own", "node", "label", "n_shingles"], None

    def edges(numbers: np.ndarray, symbols: np.ndarray) -> pa.RecordBatch:
        key, x, y, own, node, label, size = numbers
        last = np.flatnonzero(np.append((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]), True))
        end = np.repeat(last, np.diff(last, prepend=-1))  # the last row of each row's group
        one, two, loose = [], [], 0
        left, step = np.arange(len(key)), 0
        while True:
            step += 1
            left = left[left + step <= end[left]]
            if not len(left):
                break
            a, b = left, left + step
            ok = (label[a] != label[b]) & ((own[a] != own[b]) | (x[a] == y[a])) & (100 * np.minimum(size[a], size[b]) >= PERCENT * np.maximum(size[a], size[b]))
            a, b = a[ok], b[ok]
            for k in range(0, len(a), 1 << 14):
                p, q = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
                near = (symbols[p] != symbols[q]).sum(axis=1) <= DISTANCE
                one.append(node[p[near]])
                two.append(node[q[near]])
                loose += len(one[-1])
                if loose > EDGES:
                    p, q = _forest(np.concatenate(one), np.concatenate(two))
                    one, two, loose = [p], [q], 0
        a, b = np.concatenate([np.zeros(0, np.int64), *one]), np.concatenate([np.zeros(0, np.int64), *two])
        a, b = _forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = np.stack([batch[c].to_numpy() for c in names])
        symbols = text_bytes(batch["symbols"])[0].view("<u2").reshape(-1, SYMBOLS)
        if rest is not None:
            numbers, symbols = np.concatenate([rest[0], numbers], axis=1), np.concatenate([rest[1], symbols])
        whole = np.flatnonzero((numbers[:3] != numbers[:3, -1:]).any(axis=0))  # the last group may go on
        cut = int(whole[-1]) + 1 if len(whole) else 0
        rest = numbers[:, cut:], symbols[cut:]
        if cut:
            yield edges(numbers[:, :cut], symbols[:cut])
    if rest is not None:
        yield edges(*rest)


def _between(close: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between labels among the nodes of each cluster.

    All that lie outside of a cluster's largest label are compared with the whole cluster, a block of nodes with a block at a
    time, so that tasks are alike and only links are rows.
    """
    few_rows = lambda df: bounded_broadcast(held(df))
    sized = sets.select("node", F.size("shingles").cast("long").alias("size"))
    nodes = held(close.join(labels, "node").join(sized, "node"))
    by_label = nodes.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    shape = by_label.groupBy("cluster").agg(F.max(F.struct("n", "label", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES))
    shape = shape.select("cluster", F.col("top.label").alias("top"), blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("few_blocks"), blocks(F.col("n"), F.col("size")).alias("all_blocks"))
    nodes = few_rows(nodes.drop("size").join(few_rows(shape), "cluster")).join(sets, "node")
    block = lambda n: F.pmod(F.xxhash64("node"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    key = ["cluster", "x", "y"]
    few = nodes.where("label <> top").select("cluster", block(F.col("few_blocks")).alias("x"), each("all_blocks").alias("y"), "label", "shingles")
    many = nodes.select(F.col("cluster").alias("cluster_of"), each("few_blocks").alias("x_of"), block(F.col("all_blocks")).alias("y_of"), F.col("label").alias("other_label"), F.col("shingles").alias("other_shingles"))
    return held(few.groupBy(*key).cogroup(many.groupBy(*[f"{k}_of" for k in key])).applyInPandas(_compare, "a long, b long").distinct())


def _compare(few: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
    """Pairs of labels that a link joins: common shingles are counted along an index of ``many``."""
    out: list[tuple[int, int]] = []
    if len(few) and len(many):
        size = np.array([len(s) for s in many["other_shingles"]])
        values = np.concatenate(many["other_shingles"].to_list())
        owner = np.repeat(np.arange(len(many)), size)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        label = many["other_label"].to_numpy()
        for own_label, shingles in zip(few["label"], few["shingles"], strict=True):
            lo, hi = np.searchsorted(values, shingles, side="left"), np.searchsorted(values, shingles, side="right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(many))
            hit = np.flatnonzero((100 * common >= PERCENT * (size + len(shingles) - common)) & (label != own_label))
            out += [(own_label, x) for x in np.unique(label[hit]).tolist()]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without all but the first (smallest doc_id) of each component, columns as they are.

    Rows are told apart by doc_id and text: of rows that share a doc_id only those go whose own text is a copy. Rows equal
    in both are one document and stay or go together; copies with a null doc_id go where another one has an id.
    """
    gone = held(_rows(docs).where("not kept").select(F.col("doc_id").alias("gone"), F.col("t").alias("gone_t")).distinct())
    gone = bounded_broadcast(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]) & (F.xxhash64(docs["text"]) == gone["gone_t"]), "left_anti")
