"""Near-duplicate vectors through a navigable small-world graph for each shard.

Equal vectors are one class first. Classes are dealt to shards by hash; each
shard builds a hierarchical graph over its vectors and searches it for each of them. Of two
shards one is searched for the classes of the other, blocks of queries at a time, and links are told for both ends. A query whose beam is full
of linked vectors is searched again with twice the beam. On the ground layer each node is named by some of its closest
neighbours, however many crowd it out of their lists, so that beams needn't grow with a shard. A graph is a file in the shared folder; tasks read the one
that they ask, rows carry its path only. Cosines and links stand in memory for a bounded number of candidates at a time.

Recall is measured, not assumed. When a shard is built, vectors planted just inside the threshold beside its own
vectors are searched for, and the beam widens until they are found; so an audit never passes for want of links. Vectors whose vec_id is divisible by ``AUDIT`` are
also compared with all others (self matches don't count), their own shard's when it is built, then in each block as queries with the whole
shard and as nodes with the whole block; a block's beam doubles until these links are found, each query's by itself, and a scan of the shard is
what is left. The recall of audited vectors at the first beams that pass is a column of the result.

Links are cosines, in double precision, of at least ``THRESHOLD``. A query reports how
many vectors it links with, and one link for each component inside the shard
that it touches, which is enough to join all components; pairs within a group
of near copies are never listed.

Vectors that are null, zero, or hold null or non-finite components are linked with
nothing. Vectors of another dimension are never compared. Repeated rows are copies of
each other; a null vec_id is never the smallest (a component of them alone has
a null component_id and its rows are kept). Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, held, mix, new_folder, spread_join
from .components import connected_components

THRESHOLD = 0.95
SHARD_BYTES, SHARDS, SHARD_LEAST = 64 << 20, 4, 8192  # a shard's memory at most; shards that are made for the sake of more tasks, and vectors below which they aren't
BLOCK = 8192  # queries in a block, about
WIDTH, BEAM = 16, 32  # links of a node (twice that on the ground layer), first beam
ENTRIES, FLAT = 16, 4096  # nodes from which a layer is searched, nodes of a layer that is compared whole
NAMED, OWED = 8, 16  # of a node's neighbours those that name it at least, links that a node has for that
AUDIT, RECALL = 50, 0.99  # each so-manieth id is audited
PROBES, INSIDE = 64, 0.002  # planted vectors of a shard, so much above the threshold
OWN = ("audits", "roots", "found", "of", "hit")  # what a shard's file tells of its own nodes
_CELLS = 1 << 24  # of a batch's table of visited nodes
_PAIRS = 1 << 21  # candidates (query, node) whose cosines stand in memory together


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision, without overflow."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _spread(near: np.ndarray, ids: np.ndarray, vectors: np.ndarray, width: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none), up to ``width`` that are closer to it than to one another; others fill up the rest."""
    step = 256
    return np.concatenate([_spread_rows(near[k : k + step], ids[k : k + step], vectors, width) for k in range(0, max(1, len(ids)), step)])


def _spread_rows(near, ids, vectors, width):
    rows, n = ids.shape
    own = vectors[ids]
    among = own @ own.transpose(0, 2, 1)
    there, taken = ids >= 0, np.zeros((rows, n), bool)
    worst, size = np.full((rows, n), -2.0, np.float32), np.zeros(rows, np.int64)  # of each candidate the cosine with the closest one taken
    for k in range(n):
        ok = np.flatnonzero(there[:, k] & (size < width) & (worst[:, k] < near[:, k]))
        taken[ok, k] = True
        size[ok] += 1
        worst[ok] = np.maximum(worst[ok], among[ok, k])
    first = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :width]
    out = np.full((rows, width), -1, np.int32)
    out[:, : first.shape[1]] = np.take_along_axis(np.where(there, ids, -1), first, 1)
    return out


def _paired(q: np.ndarray, row: np.ndarray, v: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Products of a row of ``q`` with a row of ``v`` each, so few at a time that they stay in the cache."""
    out, step = np.empty(len(row), np.float32), 4096
    a, b = np.empty((2, min(step, len(row)), q.shape[1]), np.float32)
    for k in range(0, len(row), step):
        n = min(step, len(row) - k)
        np.take(q, row[k : k + n], axis=0, out=a[:n], mode="clip")
        np.take(v, node[k : k + n], axis=0, out=b[:n], mode="clip")
        np.einsum("ed,ed->e", a[:n], b[:n], out=out[k : k + n])
    return out


def _best(q: np.ndarray, nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` (or all) of ``nodes`` closest to each query, compared with all of them: cosines and places, in no order."""
    k, step = min(k, len(nodes)), max(1, _PAIRS // len(nodes))
    near, ids = np.empty((len(q), k), np.float32), np.empty((len(q), k), np.int32)
    for at in range(0, len(q), step):
        sims = q[at : at + step] @ nodes.T
        ids[at : at + step] = np.argpartition(sims, len(nodes) - k, axis=1)[:, len(nodes) - k :]
        near[at : at + step] = np.take_along_axis(sims, ids[at : at + step], 1)
    return near, ids


class Layer:
    """A graph over the first ``n`` vectors (in order of level, highest first)."""

    def __init__(self, vectors: np.ndarray, n: int, width: int, links: np.ndarray | None = None):
        self.v, self.n, self.width = vectors, n, width
        self.links = links if links is not None else self._grow()

    def search(self, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``beam`` nodes of each query (cosines, ids; -1: none), in batches of bounded memory."""
        step = max(1, min(256, _CELLS // max(self.n, beam * 8)))
        parts = [self._search(q[k : k + step], start[k : k + step], beam) for k in range(0, len(q), step)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros((0, beam), np.float32), np.zeros((0, beam), np.int32))

    def _search(self, q, start, beam):
        start = start[:, :beam]
        rows, wide = np.arange(len(q))[:, None], self.n + 1
        seen = np.zeros(len(q) * wide, bool)
        seen[rows * wide + start] = True
        seen[wide - 1 :: wide] = True  # stands for "none" (-1)
        ids = np.full((len(q), beam), -1, np.int32)
        near = np.full((len(q), beam), -np.inf, np.float32)
        done = np.ones((len(q), beam), bool)
        some = start.shape[1]
        ids[:, :some], done[:, :some] = start, start < 0
        near[:, :some] = np.where(start < 0, -np.inf, np.einsum("qd,qkd->qk", q, self.v[start]))
        live = np.arange(len(q))
        few = min(4, beam)
        while len(live):
            # the best nodes not yet opened
            own_near, own_ids, own_done = near[live], ids[live], done[live]
            rank = np.where(own_done, np.inf, -own_near)
            pick = np.argpartition(rank, few - 1, axis=1)[:, :few]
            good = np.take_along_axis(rank, pick, 1) < np.inf
            np.put_along_axis(own_done, pick, np.take_along_axis(own_done, pick, 1) | good, 1)
            fresh = np.where(good[:, :, None], self.links[np.take_along_axis(own_ids, pick, 1)], -1).reshape(len(live), -1)
            fresh.sort(axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            place = (live * wide)[:, None] + np.where(fresh < 0, self.n, fresh)
            at = np.flatnonzero(~seen[place])
            seen[place.reshape(-1)[at]] = True
            row, node = at // fresh.shape[1], fresh.reshape(-1)[at]
            sim = _paired(q, live[row], self.v, node)
            # those that enter the beam, packed to the left
            enter = sim > own_near.min(axis=1)[row]
            row, node, sim = row[enter], node[enter], sim[enter]
            count = np.bincount(row, minlength=len(live))
            column = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            shape = (len(live), beam + int(count.max()))
            all_near, all_ids, all_done = np.full(shape, np.inf, np.float32), np.full(shape, -1, np.int32), np.ones(shape, bool)
            all_near[:, :beam], all_ids[:, :beam], all_done[:, :beam] = -own_near, own_ids, own_done
            all_near[row, beam + column], all_ids[row, beam + column], all_done[row, beam + column] = -sim, node, False
            if shape[1] > beam:
                best = np.argpartition(all_near, beam - 1, axis=1)[:, :beam]
                all_near, all_ids, all_done = (np.take_along_axis(x, best, 1) for x in (all_near, all_ids, all_done))
            near[live], ids[live], done[live] = -all_near, all_ids, all_done
            live = live[~all_done.all(axis=1)]
        order = np.argsort(-near, axis=1, kind="stable")
        near, ids = np.take_along_axis(near, order, 1), np.take_along_axis(ids, order, 1)
        return near, np.where(near > -np.inf, ids, -1)

    def _grow(self) -> np.ndarray:
        """Inserts nodes in batches that double. A new node's candidates are the closest of all nodes before it and in its batch.

        A shard is bounded, and products of matrices find them faster than its half-grown graph does.
        """
        self.links = np.full((self.n, self.width), -1, np.int32)
        at = 0
        while at < self.n:
            end = min(self.n, at + min(4096, max(32, at)))
            new = np.arange(at, end)
            near, ids = _best(self.v[new], self.v[:end], 2 * self.width + 1)
            itself = ids == new[:, None]
            self._link(new, np.where(itself, -np.inf, near), np.where(itself, -1, ids))
            at = end
        return np.concatenate([self.links, self._owed()], axis=1)

    def _owed(self) -> np.ndarray:
        """More links: a node that others crowded out of its neighbours' lists is named by the closest of them all the same, or no beam would meet it."""
        more, used = np.full((self.n, OWED), -1, np.int32), np.zeros(self.n, np.int64)
        named = np.zeros(self.n, np.int64)
        near = np.full(self.links.shape, -np.inf, np.float32)
        for k in range(0, self.n, 2048):
            part = self.links[k : k + 2048]
            near[k : k + 2048] = np.where(part < 0, -np.inf, np.einsum("nd,nkd->nk", self.v[k : k + len(part)], self.v[part]))
        near = np.take_along_axis(self.links, np.argsort(-near, axis=1, kind="stable"), 1)
        for k in range(self.width):
            of = np.flatnonzero((named < NAMED) & (near[:, k] >= 0))
            by = near[of, k]
            there = (self.links[by] == of[:, None]).any(axis=1)
            named[of[there]] += 1
            of, by = of[~there], by[~there]
            order = np.argsort(by, kind="stable")
            of, by = of[order], by[order]
            node, first, count = np.unique(by, return_index=True, return_counts=True)
            place = used[by] + np.arange(len(by)) - np.repeat(first, count)
            fits = place < OWED
            more[by[fits], place[fits]] = of[fits]
            named[of[fits]] += 1
            used[node] = np.minimum(OWED, used[node] + count)
        return more

    def _link(self, new: np.ndarray, near: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(-near, axis=1, kind="stable")
        near, ids = np.take_along_axis(near, order, 1), np.take_along_axis(ids, order, 1)
        self.links[new] = _spread(near, ids, self.v, self.width)
        # back links: with what a node has already, the best again
        own = self.links[new]
        source, target = np.repeat(new, self.width), own.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        sim = np.einsum("ed,ed->e", self.v[source], self.v[target])
        order = np.lexsort((-sim, target))
        source, target, sim = source[order], target[order], sim[order]
        node, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        keep = place < self.width
        row = np.repeat(np.arange(len(node)), count)
        for part in range(0, len(node), 2048):
            n = node[part : part + 2048]
            inside = keep & (row >= part) & (row < part + len(n))
            back = np.full((len(n), self.width), -1, np.int32)
            back[row[inside] - part, place[inside]] = source[inside]
            both = np.sort(np.concatenate([self.links[n], back], axis=1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            near = np.einsum("nd,nkd->nk", self.v[n], self.v[both])
            near[both < 0] = -np.inf
            order = np.argsort(-near, axis=1, kind="stable")
            near, both = np.take_along_axis(near, order, 1), np.take_along_axis(both, order, 1)
            self.links[n] = both[:, : self.width]
            over = np.flatnonzero(both[:, self.width] >= 0)  # the others keep all that they have
            self.links[n[over]] = _spread(near[over], both[over], self.v, self.width)


class Graph:
    """Layers over a shard's vectors, the sparsest first; level 0 has all."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, links: list[np.ndarray] | None = None, own: dict[str, np.ndarray] | None = None, beam: int = BEAM, audited: np.ndarray | None = None):
        if links is None:  # a node is on level k with a chance of WIDTH ** -k, told by its id
            chance = (mix(ids.view(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53
            level = np.floor(-np.log(np.maximum(chance, 1e-18)) / np.log(WIDTH)).astype(np.int64)
            order = np.argsort(-level, kind="stable")
            ids, counts, vectors, level = ids[order], counts[order], vectors[order], level[order]
            audited = np.zeros(len(ids), bool) if audited is None else audited[order]
        self.ids, self.counts, self.exact = ids, counts, vectors
        self.v, self.beam = vectors.astype(np.float32), beam
        if links is None:
            sizes = [int((level >= k).sum()) for k in range(int(level[0]), -1, -1)]
            self.layers = [Layer(self.v, n, 2 * WIDTH if n == len(ids) else WIDTH) for n in sorted({*sizes, len(ids)})]
            self.beam = self._probe()
            own = self._own(audited)
        else:
            self.layers = [Layer(self.v, len(x), x.shape[1], x) for x in links]
        self.audits, self.roots, self.found, self.of, self.hit = (own[k] for k in OWN)

    def near_parts(self, q: np.ndarray, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) of the links found by a first beam of ``beam``, so many queries at a time; full beams widen. A query's links come together."""
        left, start = np.arange(len(q)), self._entries(q)
        while len(left):
            beam, over = min(beam, len(self.ids)), []
            for part in np.array_split(left, min(len(left), -(-len(left) * beam // _PAIRS))):
                _, ids = self.layers[-1].search(q[part].astype(np.float32), start[part], beam)
                hit = (self._cosines(q[part], ids) >= THRESHOLD) & (ids >= 0)
                full = (hit.sum(axis=1) >= 0.75 * beam) & (beam < len(self.ids))
                a, b = np.nonzero(hit & ~full[:, None])
                yield part[a], ids[a, b].astype(np.int64)
                over.append(part[full])
            left, beam = np.concatenate(over), beam * 2

    def _entries(self, q: np.ndarray) -> np.ndarray:
        """Nodes of the layer above the ground to start from: the sparsest layers, up to ``FLAT`` nodes, are compared whole, those below searched."""
        start, q = np.zeros((len(q), 1), np.int32), q.astype(np.float32)
        flat = [x for x in self.layers[:-1] if x.n <= FLAT]
        if flat:
            start = _best(q, self.v[: flat[-1].n], ENTRIES)[1]
        for layer in self.layers[len(flat) : -1]:
            start = layer.search(q, start, ENTRIES)[1]
        return start

    def _cosines(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        step = max(1, _PAIRS // (ids.shape[1] * q.shape[1]))
        return np.concatenate([np.einsum("qd,qkd->qk", q[k : k + step], self.exact[ids[k : k + step]]) for k in range(0, len(q), step)])

    def scan_parts(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same links by a comparison with every node."""
        step = max(1, _PAIRS // len(self.ids))
        for k in range(0, len(q), step):
            a, b = np.nonzero(q[k : k + step] @ self.exact.T >= THRESHOLD)
            yield a + k, b

    def audited(self, q: np.ndarray, own: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """The first beam that ``fitted`` finds for audited queries, and for each one its links by a scan and how many were found.

        ``own`` is the node that a query is itself (-1: none), which isn't counted.
        """
        n = len(self.ids)
        truth = [np.zeros(0, np.int64)]
        for a, b in self.scan_parts(q):
            other = own[a] != b
            truth.append(a[other] * n + b[other])
        beam, truth, got = self.fitted(q, np.concatenate(truth))
        return beam, np.bincount(truth // n, minlength=len(q)), np.bincount(truth[got] // n, minlength=len(q))

    def audited_ends(self, q: np.ndarray, audit: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """The first beam for a block of queries from other shards, the links told by scans in which the query (one of ``audit``) or the node is audited (query * n + node), and whether each was found."""
        n, nodes = len(self.ids), np.flatnonzero(self.audits)
        truth = [np.zeros(0, np.int64), *[audit[a] * n + b for a, b in self.scan_parts(q[audit])]]
        step = max(1, _PAIRS // max(1, len(nodes)))
        for k in range(0, len(q), step):
            a, b = np.nonzero(q[k : k + step] @ self.exact[nodes].T >= THRESHOLD)
            truth.append((a + k) * n + nodes[b])
        return self.fitted(q, np.unique(np.concatenate(truth)))

    def fitted(self, q: np.ndarray, truth: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """The first beam, doubled from the shard's until each query has its links of ``truth`` (query * n + node), these links, and whether each was found."""
        n, beam = len(self.ids), self.beam
        asked = np.unique(truth // n)
        there = np.bincount(truth // n, minlength=len(q))[asked]
        while beam < n:
            got = np.zeros(len(truth), bool)
            for a, b in self.near_parts(q[asked], beam):
                got |= np.isin(truth, asked[a] * n + b)
            if (np.bincount(truth[got] // n, minlength=len(q))[asked] >= RECALL * there).all():
                return beam, truth, got
            beam *= 2
        return n, truth, np.ones(len(truth), bool)

    def parts(self, q: np.ndarray, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of a block of queries by a first beam of ``beam`` (all nodes: a scan), so many queries at a time."""
        return self.near_parts(q, beam) if beam < len(self.ids) else self.scan_parts(q)

    def scan(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _joined(self.scan_parts(q))

    def links(self, q: np.ndarray, audit: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All links of a block of queries at once (query, node), and for each of ``audit`` its links by a scan and how many of them were found."""
        audit = np.zeros(0, np.int64) if audit is None else audit
        own = np.full(len(q), -1) if own is None else own
        beam, of, hit = self.audited(q[audit], own[audit])
        return *_joined(self.parts(q, beam)), of, hit

    def _probe(self) -> int:
        """The least beam that finds the vector beside which each planted one lies."""
        rng = np.random.default_rng(5)
        at = np.unique(np.linspace(0, len(self.ids) - 1, PROBES).astype(np.int64))
        v = self.exact[at]
        aside = rng.normal(size=v.shape)
        aside -= (aside * v).sum(axis=1, keepdims=True) * v
        norm = np.linalg.norm(aside, axis=1, keepdims=True)
        near = THRESHOLD + INSIDE
        q = np.where(norm > 1e-9, near * v + (1 - near**2) ** 0.5 * aside / np.maximum(norm, 1e-9), v)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        beam = BEAM
        while beam < len(self.ids):
            a, b = _joined(self.near_parts(q, beam))
            if np.isin(np.arange(len(at)) * len(self.ids) + at, a * len(self.ids) + b).mean() >= RECALL:
                break
            beam *= 2
        return beam

    def _own(self, audited: np.ndarray) -> dict[str, np.ndarray]:
        """Of the shard's own nodes: which are audited, the least node of each one's component by links inside the shard, the vectors linked there, and audits."""
        n = len(self.ids)
        root, found, there, seen = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        each = np.flatnonzero(audited | (mix(self.ids.view(np.uint64)) % np.uint64(AUDIT) == 0))
        beam, there[each], seen[each] = self.audited(self.exact[each], each)
        for a, b in self.parts(self.exact, beam):
            other = a != b
            a, b = a[other], b[other]
            found += np.bincount(a, weights=self.counts[b], minlength=n).astype(np.int64)
            root = _united(root, a, b)
        return dict(zip(OWN, (audited, root, found, np.where(audited, there, 0), np.where(audited, seen, 0)), strict=True))

    def write(self, out: BinaryIO) -> None:
        own = dict(zip(OWN, (self.audits, self.roots, self.found, self.of, self.hit), strict=True))
        np.savez(out, ids=self.ids, counts=self.counts, exact=self.exact, beam=self.beam, **own, **{f"layer{k:02d}": x.links for k, x in enumerate(self.layers)})

    def dump(self) -> bytes:
        out = io.BytesIO()
        self.write(out)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes | BinaryIO) -> Graph:
        z = np.load(io.BytesIO(raw) if isinstance(raw, bytes) else raw)
        return cls(z["ids"], z["counts"], z["exact"], [z[k] for k in sorted(z.files) if k.startswith("layer")], {k: z[k] for k in OWN}, int(z["beam"]))


def _joined(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *parts, strict=True))


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each component (``root``) after more links between nodes."""
    a, b = root[a], root[b]
    low = np.arange(len(root))
    while True:
        less = low.copy()
        np.minimum.at(less, a, low[b])
        np.minimum.at(less, b, low[a])
        less = less[less]
        if (less == low).all():
            return low[root]
        low = less


def _matrix(column: pd.Series) -> np.ndarray:
    return unit(np.stack(column.to_numpy()))


def _build(folder: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def build(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        audited = f["audited"].to_numpy(bool) if "audited" in f else None
        g = Graph(f["node"].to_numpy(np.int64), f["copies"].to_numpy(np.int64), _matrix(f["embedding"]), audited=audited)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        name = f"{uuid.uuid4().hex}.npz"  # an attempt's own
        with store.open_output_stream(f"{base}/{name}") as out:
            g.write(out)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "graph": [f"{folder}/{name}"]})

    return build


def _query(f: pd.DataFrame) -> pd.DataFrame:
    """Links between a block of queries and a shard, told for both ends: the vectors linked (``found``), a link to each component there, and of audited ones the links told by scans and found.

    For queries that are nodes of the shard all that is in its file.
    """
    store, path = fs.FileSystem.from_uri(f["graph"].iloc[0])
    with store.open_input_file(path) as raw:
        g = Graph.load(raw)
    n = len(g.ids)
    inside = f["home"].to_numpy() == f["shard"].to_numpy()
    order = np.argsort(g.ids, kind="stable")
    own = order[np.searchsorted(g.ids, f["node"].to_numpy(np.int64)[inside], sorter=order)]
    f = f[~inside]
    node, copies, q = f["node"].to_numpy(np.int64), f["copies"].to_numpy(np.int64), _matrix(f["embedding"]) if len(f) else np.zeros((0, g.exact.shape[1]))
    beam, truth, got = g.audited_ends(q, np.flatnonzero(f["audited"].to_numpy(bool)))
    found, back, pairs = np.zeros(len(node), np.int64), np.zeros(n, np.int64), [np.zeros(0, np.int64)]
    for a, b in g.parts(q, beam):
        found += np.bincount(a, weights=g.counts[b], minlength=len(node)).astype(np.int64)
        back += np.bincount(b, weights=copies[a], minlength=n).astype(np.int64)
        pairs.append(np.unique(a * n + g.roots[b]))  # a query's links come together
    linked, to = np.divmod(np.concatenate(pairs), n)
    asks, ends = np.divmod(truth, n)
    counted = lambda x, k: (np.bincount(x, minlength=k), np.bincount(x[got], minlength=k))
    parts = [(node, found, *np.where(f["audited"].to_numpy(bool), counted(asks, len(node)), 0)), (g.ids, back, *np.where(g.audits, counted(ends, n), 0)), (g.ids[own], g.found[own], g.of[own], g.hit[own])]
    told = pd.concat([pd.DataFrame({"node": i, "found": x, "other": i, "of": y, "hit": z}) for i, x, y, z in parts])
    joins = [(node[linked], g.ids[to]), (g.ids[own], g.ids[g.roots[own]])]
    joins = pd.concat([pd.DataFrame({"node": i, "found": 0, "other": x, "of": 0, "hit": 0}) for i, x in joins])
    return pd.concat([told[(told["found"] > 0) | (told["of"] > 0)], joins[joins["node"] != joins["other"]]])


def _asked(dealt: DataFrame, shards: int) -> DataFrame:
    """Vectors with each shard that is asked for them: their own (``home``), which tells what its file says, and those up to half way round after it.

    So of two shards one is asked for the other's vectors, each shard about as often.
    """
    ahead = F.when(F.col("home") < shards // 2, shards // 2).otherwise((shards - 1) // 2)
    asked = dealt.withColumnRenamed("shard", "home").withColumn("ahead", F.explode(F.sequence(F.lit(0), ahead)))
    return asked.withColumn("shard", F.pmod(F.col("home") + F.col("ahead"), F.lit(shards))).drop("ahead")


def near_duplicates(vectors: DataFrame, with_recall: bool = False) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row, and ``recall`` of the audited ones that have links (share of the linked classes found)."""
    rows = held(vectors.select("vec_id", "embedding").withColumn("row", F.monotonically_increasing_id()))
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    limit = F.lit(float("inf"))
    usable = F.coalesce(F.forall(numbers, lambda x: x.isNotNull() & (F.abs(x) < limit)) & F.exists(numbers, lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    classes = held(good.groupBy("embedding").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.max(F.coalesce(F.col("vec_id") % AUDIT == 0, F.lit(False))).alias("audited")))
    size = classes.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("dim")).first()
    # by memory, and for small tables a few for the sake of more tasks, but none too small: each more is half a search more for every vector
    shards = max(1, -(-size.n * size.dim * 12 // SHARD_BYTES), min(SHARDS, -(-size.n // SHARD_LEAST)))
    blocks = max(1, -(-size.n // BLOCK))
    dealt = classes.select("node", "copies", "embedding", "audited", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(shards)).alias("shard"), F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)).alias("block"))
    # heavy work on few rows: the numbers of partitions are given, or they would be merged by size
    graphs = held(dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(_build(new_folder(vectors.sparkSession, "graphs")), "dim int, shard long, graph string"))
    asked = _asked(dealt, shards).join(bounded_broadcast(graphs), ["dim", "shard"])
    key = ["dim", "shard", "block"]
    answers = held(asked.repartition(shards * blocks, *key).groupBy(*key).applyInPandas(_query, "node long, found long, other long, of long, hit long"))
    links = answers.groupBy("node").agg(F.sum("found").alias("found"), F.sum("of").alias("of"), F.sum("hit").alias("hit"))
    roots = connected_components(answers.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    joined = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    code = F.xxhash64(F.transform("embedding", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0; rows are sorted by it, vectors compared where it is equal
    named = joined.join(least, "root").join(links, "node", "left")
    named = held(named.select(code.alias("code"), F.col("embedding").alias("key"), "component_id", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("of") > 0, F.col("hit") / F.col("of")).alias("recall"), F.col("copies").alias("n")))
    # by the class's own vector, a very common one dealt to several tasks; rows that are linked with nothing have none
    keyed = rows.select("vec_id", "row", code.alias("code"), F.when(usable, F.col("embedding")).alias("key"))
    out = spread_join(keyed, named.drop("n"), ["code", "key"], "row", "left", named.select("code", "key", "n"))
    component = F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), "recall")
    out = out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
    return out if with_recall else out.drop("recall")
