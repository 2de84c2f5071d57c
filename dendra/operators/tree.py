"""Sequential kernels on spanning trees and hierarchies, for one task: n - 1 edges in, tree rows out.

All ids here are dense: points 0 to n - 1, merges from n on, condensed clusters from n on
with the root n.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from ..errors import Disconnected
from ..plans.config import LEAF, ExtractionConfig


class Forest:
    """Disjoint sets that remember one number for each root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


@dataclass
class Edges:
    src: np.ndarray
    dst: np.ndarray
    distance: np.ndarray

    def ordered(self) -> Edges:
        """By distance alone; equal edges keep their order."""
        at = np.argsort(self.distance, kind="stable")
        return Edges(self.src[at], self.dst[at], self.distance[at])


def prim(n: int, reach: Callable[[int, np.ndarray], np.ndarray]) -> Edges:
    """Spanning tree from vertex 0; among equals the smallest id joins first, under the first vertex that reached it.

    ``reach(i, others)`` gives the weights from i to others. Only the frontier is held;
    joined vertices stay in it, out of reach, until a tenth of it has joined, so that
    ``others`` is the same array over many steps.
    """
    outside = np.arange(1, n)
    best, source, joined = np.full(n - 1, np.inf), np.zeros(n - 1, np.int64), np.zeros(n - 1)
    src, dst, weight = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64), np.zeros(n - 1)
    now, gone = 0, 0
    for step in range(n - 1):
        if gone * 10 > len(outside):
            keep = joined == 0
            outside, best, source, joined, gone = outside[keep], best[keep], source[keep], joined[keep], 0
        fresh = reach(now, outside) + joined
        nearer = np.flatnonzero(fresh < best)
        best[nearer], source[nearer] = fresh[nearer], now
        pick = int(best.argmin())
        if best[pick] == np.inf:
            raise Disconnected("a part of the points can't be reached over finite distances")
        now = int(outside[pick])
        src[step], dst[step], weight[step] = source[pick], now, best[pick]
        best[pick] = joined[pick] = np.inf
        gone += 1
    return Edges(src, dst, weight)


def kruskal(n: int, src: np.ndarray, dst: np.ndarray, distance: np.ndarray, keys: Sequence[np.ndarray] = ()) -> Edges:
    """Spanning forest in the order of (distance, keys, smaller id, larger id)."""
    low, high = np.minimum(src, dst), np.maximum(src, dst)
    at = np.lexsort((high, low, *reversed(keys), distance))
    forest, taken = Forest(n), []
    for e in at.tolist():
        if forest.join(int(low[e]), int(high[e])):
            taken.append(e)
            if len(taken) == n - 1:
                break
    return Edges(low[taken], high[taken], distance[taken])


def connected(n: int, edges: Edges) -> Edges:
    if len(edges.src) != n - 1 or np.isinf(edges.distance).any():
        raise Disconnected(f"{n - int(np.isfinite(edges.distance).sum())} components")
    return edges


@dataclass
class Linkage:
    left: np.ndarray
    right: np.ndarray
    distance: np.ndarray
    size: np.ndarray


def linkage(n: int, edges: Edges) -> Linkage:
    """Merges in the order of the edges; row i makes node n + i."""
    forest = np.arange(2 * n - 1)
    size = np.ones(2 * n - 1, np.int64)
    left, right = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64)

    def top(x: int) -> int:
        while forest[x] != x:
            forest[x] = forest[forest[x]]
            x = forest[x]
        return int(x)

    for i in range(n - 1):
        a, b = top(int(edges.src[i])), top(int(edges.dst[i]))
        left[i], right[i] = a, b
        forest[a] = forest[b] = n + i
        size[n + i] = size[a] + size[b]
    return Linkage(left, right, edges.distance.copy(), size[n:])


@dataclass
class Condensed:
    n: int
    parent: np.ndarray
    child: np.ndarray
    density: np.ndarray
    size: np.ndarray


def condense(link: Linkage, least: int) -> Condensed:
    """Splits where both sides have ``least`` points; smaller sides fall out point by point."""
    n = len(link.left) + 1
    rows: list[tuple[int, int, float, int]] = []
    left, right = link.left.tolist(), link.right.tolist()
    size = [1] * n + link.size.tolist()

    def level_order(top: int) -> list[int]:
        out = [top]
        for x in out:  # grows while it is read
            if x >= n:
                out += (left[x - n], right[x - n])
        return out

    following = n + 1
    work = [(2 * n - 2, n)]
    for node, cluster in work:
        d = link.distance[node - n]
        density = 1 / d if d > 0 else np.inf
        sides = (left[node - n], right[node - n])
        big = [s for s in sides if size[s] >= least]
        if len(big) == 2:
            for s in sides:
                rows.append((cluster, following, density, size[s]))
                work.append((s, following))
                following += 1
            continue
        for s in sides:
            if s not in big:
                rows += ((cluster, p, density, 1) for p in level_order(s) if p < n)
        if big:
            work.append((big[0], cluster))
    table = np.array(rows, dtype=[("p", "i8"), ("c", "i8"), ("d", "f8"), ("s", "i8")])
    return Condensed(n, table["p"].copy(), table["c"].copy(), table["d"].copy(), table["s"].copy())


def stabilities(tree: Condensed) -> np.ndarray:
    """By cluster id; NaN may come of clusters that are born at infinite density, and stays."""
    ids = max(int(tree.parent.max()), int(tree.child.max()), tree.n) + 1 if len(tree.parent) else tree.n + 1
    birth = np.full(ids, np.inf)
    np.minimum.at(birth, tree.child, tree.density)
    if len(tree.parent):
        birth[tree.parent[0]] = 0.0
    out = np.zeros(ids)
    with np.errstate(invalid="ignore"):
        np.add.at(out, tree.parent, (tree.density - birth[tree.parent]) * tree.size)
    return out


def own_peak(tree: Condensed, ids: int) -> np.ndarray:
    """Largest density among a cluster's own rows."""
    out = np.zeros(ids)
    np.maximum.at(out, tree.parent, tree.density)
    return out


def subtree_peak(tree: Condensed, ids: int) -> np.ndarray:
    """Largest density in a cluster and below it; children have larger ids than their parents."""
    out = own_peak(tree, ids)
    for e in np.flatnonzero(tree.size > 1)[::-1]:
        p, c = tree.parent[e], tree.child[e]
        if out[c] > out[p]:
            out[p] = out[c]
    return out


@dataclass
class Flat:
    labels: np.ndarray
    probabilities: np.ndarray
    persistence: np.ndarray
    clusters: np.ndarray
    stability: np.ndarray


def _children(tree: Condensed) -> tuple[dict[int, list[int]], dict[int, tuple[int, float, int]]]:
    below: dict[int, list[int]] = {}
    above: dict[int, tuple[int, float, int]] = {}
    for e in np.flatnonzero(tree.size > 1).tolist():
        p, c = int(tree.parent[e]), int(tree.child[e])
        below.setdefault(p, []).append(c)
        above[c] = (p, float(tree.density[e]), int(tree.size[e]))
    return below, above


def choose(tree: Condensed, stability: np.ndarray, config: ExtractionConfig) -> list[int]:
    """Selected cluster ids, ascending. ``stability`` takes the children's sum where they win."""
    if not len(tree.parent):
        return []
    root = int(tree.parent[0])
    below, above = _children(tree)
    if config.method == LEAF:
        chosen = {c for c in above if c not in below}
    else:
        wins: set[int] = set()
        for c in sorted({*np.unique(tree.parent).tolist()}, reverse=True):
            if c == root and not config.allow_single_cluster:
                continue
            total = sum(stability[x] for x in below.get(c, []))
            too_large = config.max_cluster_size > 0 and above.get(c, (0, 0.0, 0))[2] > config.max_cluster_size
            if total > stability[c] or too_large:
                stability[c] = total
            else:
                wins.add(c)
        chosen: set[int] = set()
        work = [root]
        for c in work:  # grows while it is read: the highest winners
            if c in wins:
                chosen.add(c)
            else:
                work += below.get(c, [])
    if config.epsilon > 0 and chosen:
        limit, merged = 1 / config.epsilon, set()
        for c in chosen:
            while c in above and above[c][1] > limit and (above[c][0] != root or config.allow_single_cluster):
                c = above[c][0]
            merged.add(c)
        chosen = merged
    return sorted(chosen)


def nearest_chosen(tree: Condensed, chosen: Sequence[int], ids: int) -> np.ndarray:
    """For each cluster id the lowest chosen cluster at or above it, or -1."""
    out = np.full(ids, -1)
    picked = set(chosen)
    root = int(tree.parent[0])
    out[root] = root if root in picked else -1
    for e in np.flatnonzero(tree.size > 1):
        c = int(tree.child[e])
        out[c] = c if c in picked else out[tree.parent[e]]
    return out


def extract(tree: Condensed, config: ExtractionConfig) -> Flat:
    n = tree.n
    labels, probabilities = np.full(n, -1), np.zeros(n)
    stability = stabilities(tree)
    if not len(tree.parent):
        return Flat(labels, probabilities, np.zeros(0), np.zeros(0, np.int64), stability)
    ids, root = len(stability), int(tree.parent[0])
    chosen = choose(tree, stability, config)
    number = {c: i for i, c in enumerate(chosen)}
    over = nearest_chosen(tree, chosen, ids)
    peak, own = subtree_peak(tree, ids), own_peak(tree, ids)
    points = np.flatnonzero(tree.child < n)
    at, density = tree.child[points], tree.density[points]
    cluster = over[tree.parent[points]]
    inside = cluster >= 0
    if config.allow_single_cluster and chosen == [root]:
        inside &= density >= own[root]
    labels[at[inside]] = [number[c] for c in cluster[inside].tolist()]
    top = peak[cluster]
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where((top == 0) | np.isinf(density), 1.0, np.minimum(density, top) / top)
    probabilities[at[inside]] = share[inside]
    counts = np.bincount(labels[labels >= 0], minlength=len(chosen))
    most = tree.density.max()
    with np.errstate(invalid="ignore", divide="ignore"):
        persistence = np.array([1.0 if np.isinf(most) or most == 0 or counts[i] == 0 else stability[c] / (counts[i] * most) for i, c in enumerate(chosen)])
    if config.persistence > 0 and len(chosen):
        weak = (labels >= 0) & (persistence[labels] < config.persistence)
        labels[weak], probabilities[weak] = -1, 0.0
    return Flat(labels, probabilities, persistence, np.array(chosen, np.int64), stability)


def outliers(tree: Condensed) -> np.ndarray:
    """How far a point's density lies under the peak of the cluster it left; NaN where that peak alone is infinite."""
    out = np.zeros(tree.n)
    if not len(tree.parent):
        return out
    peak = subtree_peak(tree, max(int(tree.parent.max()), int(tree.child.max())) + 1)
    points = np.flatnonzero(tree.child < tree.n)
    density, top = tree.density[points], peak[tree.parent[points]]
    with np.errstate(invalid="ignore", divide="ignore"):
        out[tree.child[points]] = np.where((top == 0) | np.isinf(density), 0.0, (top - density) / top)
    return out


def cut_labels(link: Linkage, cut: float, least: int) -> np.ndarray:
    """Components of the merges under ``cut``, numbered by first appearance; small ones are -1."""
    n = len(link.left) + 1
    forest = Forest(2 * n - 1)
    for i in np.flatnonzero(link.distance < cut).tolist():
        forest.join(int(link.left[i]), n + i)
        forest.join(int(link.right[i]), n + i)
    root = np.array([forest.find(i) for i in range(n)])
    _, first, where, count = np.unique(root, return_index=True, return_inverse=True, return_counts=True)
    number = np.full(len(first), -1)
    order = [g for g in np.argsort(first) if count[g] >= least]
    number[order] = np.arange(len(order))
    return number[where]
