"""Spanning trees of matrices and graphs that come by rows, of which no task holds more than a few.

Rows are read twice. First each gives its core distance, its nearest others and the least of
its edges to a sample of vertices, and a sum that is equal on both sides of the diagonal where
the graph is symmetric. A tree of these edges, in the order of its hierarchy (see ``spanning``),
bounds what an edge of the whole tree weighs between any two vertices, or tells nothing where
it doesn't join them. Then each row gives the edges within that bound, of which a task keeps
a forest; forests are merged in rounds. The sample bears on speed alone: every entry is met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..errors import InsufficientNeighbors, InvalidPrecomputed, InvalidSparse
from ..sources.graphs import Rows
from . import spanning
from .tree import Edges, Forest, kruskal

#: Nearest others that a row tells at least, and vertices of the sample.
NEAR, SAMPLE = 8, 1024
_SUMMARY = "id long, core double, stored long, wrong long, above long, below long, others binary, distances binary"


@dataclass
class Summary:
    """On the driver: core distances by vertex, and some edges."""

    core: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    distance: np.ndarray


def mixed(n: int) -> np.ndarray:
    """A word for each vertex (SplitMix64)."""
    z = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def least_places(d: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least values by (value, place), of all if there are fewer."""
    groups = max(4 * k, 64)
    part = len(d) // groups
    at = np.arange(len(d))
    if part > 1:  # k values lie within the k-th of the groups' least
        at = np.flatnonzero(d <= np.partition(d[: groups * part].reshape(groups, part).min(axis=1), k - 1)[k - 1])
    return at[np.argsort(d[at], kind="stable")[:k]]


def summary(rows: Rows, n: int, k: int, dense: bool) -> Summary:
    """One reading of all rows: checks them, finds core distances of the ``k``-th other and edges that join most vertices."""
    sample = np.unique(np.linspace(0, n - 1, min(n, SAMPLE)).astype(np.int64))
    read, near = rows.read, max(k, NEAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, sampled = mixed(n), np.zeros(n, bool)
        sampled[sample] = True
        shift, odd = np.uint64(32), np.uint64(0xD6E8FEB86659FD93)
        for i, others, d in read(batches):
            wrong = 0 if 0 <= i < n else 1
            if dense:
                wrong += len(d) != n or not wrong and d[i] != 0
            else:
                wrong += len(others) != len(d) or bool(len(others) and (others[0] < 0 or others[-1] >= n or (np.diff(others) <= 0).any()))
            if not wrong:
                low, high = d.min(initial=np.inf), d.max(initial=0.0)  # NaN shows in both
                wrong = int(not low >= 0 or np.isnan(high) or (not dense and high == np.inf))
                if not dense and (own := int(np.searchsorted(others, i))) < len(others) and others[own] == i:
                    wrong += d[own] != 0
                    others, d = np.delete(others, own), np.delete(d, own)
            if wrong:
                yield _record(i, None, 0, int(wrong), 0, 0, np.zeros(0, np.int64), np.zeros(0))
                continue
            cut = i if dense else int(np.searchsorted(others, i))
            bits = (d + 0.0).view(np.uint64)
            bits = (bits ^ (bits >> shift)) + odd
            bits *= word if dense else word[others]
            below, above = (int(word[i]) * int(v.sum(dtype=np.uint64)) for v in (bits[:cut], bits[cut + dense :]))
            if dense:
                d = d.copy()
                d[i] = np.inf
                at = least_places(d, min(near + 1, n))
                at = at[at != i][:near]
                mine = sample[sample != i]
                others, stored = np.arange(n), n - 1
            else:
                at, mine, stored = least_places(d, near), np.flatnonzero(sampled[others]), len(others)
            core = float(d[at[k - 1]]) if len(at) >= k else None
            if len(mine) and not sampled[i]:
                mine = mine[[d[mine].argmin()]]
            at = np.unique(np.concatenate([at, mine]))
            at = at[np.isfinite(d[at])]
            yield _record(i, core, stored, 0, above, below, others[at].astype(np.int64), d[at])

    table = rows.df.mapInArrow(run, _SUMMARY).toArrow().sort_by("id")
    ids = table.column("id").to_numpy()
    _check(table, ids, n, k, dense)
    core = np.full(n, np.nan)
    core[ids] = table.column("core").to_numpy()
    others = [np.frombuffer(v, np.int64) for v in table.column("others").to_pylist()]
    src = np.repeat(ids, [len(v) for v in others])
    return Summary(core, src, np.concatenate(others), np.frombuffer(b"".join(table.column("distances").to_pylist())))


def _record(i, core, stored, wrong, above, below, others: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    signed = (int(np.uint64(v & 0xFFFFFFFFFFFFFFFF).astype(np.int64)) for v in (above, below))
    values = (int(i), core, int(stored), int(wrong), *signed, others.tobytes(), d.tobytes())
    kinds = (pa.int64(), pa.float64(), *[pa.int64()] * 4, pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _SUMMARY.split(", ")])


def _check(table: pa.Table, ids: np.ndarray, n: int, k: int, dense: bool) -> None:
    error = InvalidPrecomputed if dense else InvalidSparse
    if wrong := int(table.column("wrong").to_numpy().astype(bool).sum()):
        raise error(f"{wrong} rows are out of range, of a wrong length or order, or have entries that are negative, not finite or off zero on the diagonal")
    if len(np.unique(ids)) != len(ids) or (dense and len(ids) != n):
        raise error(f"{len(ids)} rows with {len(np.unique(ids))} ids, not {n}")
    above, below = (table.column(c).to_numpy().astype(np.uint64).sum(dtype=np.uint64) for c in ("above", "below"))
    if above != below:
        raise error("entries aren't symmetric")
    stored = np.zeros(n, np.int64)
    stored[ids] = table.column("stored").to_numpy()
    if (stored < k).any():
        lacking = int(np.flatnonzero(stored < k)[0])
        raise InsufficientNeighbors(f"vertex {lacking} has {stored[lacking]} neighbours, {k} are needed")


@dataclass
class Bounds:
    """What an edge of the whole tree weighs at most between two turns of a walk: the greatest height between them."""

    turn: np.ndarray
    order: np.ndarray
    height: np.ndarray
    core: np.ndarray
    #: By power of two, the greatest of so many heights from each on.
    table: np.ndarray

    @classmethod
    def of(cls, found: Summary, alpha: float) -> Bounds:
        n = len(found.core)
        w = np.maximum(found.distance / alpha, np.maximum(found.core[found.src], found.core[found.dst]))
        low, high = np.minimum(found.src, found.dst), np.maximum(found.src, found.dst)
        _, once = np.unique(low * n + high, return_index=True)
        tree = kruskal(n, low[once], high[once], w[once])
        sets = Forest(n)
        for a, b in zip(tree.src.tolist(), tree.dst.tolist(), strict=True):
            sets.join(a, b)
        tops = np.unique([sets.find(i) for i in range(n)])
        src, dst = (np.concatenate([c, v]) for c, v in ((tree.src, tops[:-1]), (tree.dst, tops[1:])))
        order, height = spanning.walk_of(n, Edges(src, dst, np.concatenate([tree.distance, np.full(len(tops) - 1, np.inf)])))
        turn = np.zeros(n, np.int64)
        turn[order] = np.arange(n)
        height = height[: n - 1]
        levels = [height]
        while 2 * (step := 1 << (len(levels) - 1)) <= n - 1:
            last = levels[-1]
            levels.append(np.concatenate([np.maximum(last[: n - 1 - step], last[step:]), last[n - 1 - step :]]))
        return cls(turn, order, height, found.core, np.stack(levels))

    def within(self, i: int, others: np.ndarray | None, d: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """Vertices after ``i`` in the walk that an edge of the whole tree may join it to, and the weights there."""
        t = int(self.turn[i])
        if others is None:
            later = self.order[t + 1 :]
            d, most = d[later], np.maximum.accumulate(self.height[t:])
        else:
            at = self.turn[others]
            held = np.flatnonzero(at > t)
            later, d, at = others[held], d[held], at[held]
            if not len(at):
                return later, d
            if 16 * len(at) >= len(self.turn) - t:
                most = np.maximum.accumulate(self.height[t:])[at - t - 1]
            else:
                level = np.frexp((at - t).astype(float))[1] - 1
                most = np.maximum(self.table[level, t], self.table[level, at - (1 << level)])
        w = np.maximum(np.maximum(d / alpha if alpha != 1 else d, self.core[i]), self.core[later])
        keep = np.flatnonzero((w <= most) & (w < np.inf))
        return later[keep], w[keep]


def tree_edges(rows: Rows, found: Summary, alpha: float) -> DataFrame:
    """(src, dst, distance): the edges of the spanning forest in the order (reach, smaller id, larger id), by a second reading."""
    n, read, parts = len(found.core), rows.read, 2 * rows.df.sparkSession.sparkContext.defaultParallelism
    held = rows.df.sparkSession.sparkContext.broadcast(Bounds.of(found, alpha))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, edges, waiting, size = held.value, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0
        for i, others, d in read(batches):
            later, w = bounds.within(i, others, d, alpha)
            waiting.append((np.full(len(later), i), later, w))
            size += len(later)
            if size > 4 * n:
                edges, waiting, size = _spanned([edges, *waiting]), [], 0
        src, dst, d = _spanned([edges, *waiting])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(src), TaskContext.get().partitionId() % parts, np.int32)), pa.array(src), pa.array(dst), pa.array(d)], names=["part", "src", "dst", "distance"])

    return spanning._merged(rows.df.mapInArrow(run, f"part int, {spanning._EDGE}"), parts)


def _spanned(edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    src, dst, d = (np.concatenate(c) for c in zip(*edges, strict=True))
    return spanning._spanning(src.astype(np.int64), dst.astype(np.int64), d)
