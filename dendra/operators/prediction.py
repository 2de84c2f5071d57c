"""Prediction for new points, and soft membership.

The distance work is a search of the fitted vectors: sent with the task if they are
small by a check of their size, which serves streams too, and a neighbour join beyond.
Both give equal neighbours. What is looked up afterwards (the tree above a neighbour,
peaks, merge heights, exemplars) is prepared once per fit and sent with the task;
queries are scored batch by batch, without state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PredictionUnsupported
from ..functions.metrics import Metric
from ..plans.lineage import stored
from ..sources import vectors
from . import cells, neighbors
from .tree import choose, nearest_chosen, own_peak, stabilities, subtree_peak

_MAX = float(np.finfo(np.float64).max)


#: Bytes of fitted vectors that go with a task at most; beyond, queries find their neighbours by a join.
SENT_BYTES = 8 * neighbors.BROADCAST_BYTES


def density_at(distance: np.ndarray) -> np.ndarray:
    return np.divide(1.0, distance, out=np.full(len(distance), _MAX), where=distance > 0)


@dataclass
class Lookup:
    """What scoring needs of a fit, in places of points by ascending id."""

    ids: np.ndarray
    x: np.ndarray | None
    core: np.ndarray | None
    samples: int
    metric: Metric
    root: int
    clusters: np.ndarray
    label_of: np.ndarray
    peak_of: np.ndarray
    own: np.ndarray
    peak: np.ndarray
    up: np.ndarray
    birth: np.ndarray
    point_cluster: np.ndarray
    point_density: np.ndarray
    exemplars: np.ndarray
    #: How many exemplars each selected cluster has, in their order.
    counts: np.ndarray
    #: Selected clusters in the order of a walk from the root: where those at or below each cluster begin, how many they are, and each label's turn.
    begin: np.ndarray
    under: np.ndarray
    turn: np.ndarray

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Connecting neighbour, density there, and the least distance, for each query."""
        limit, own_at = self.reach()
        d = self.metric.kernel(q, self.x)
        farthest = np.partition(d, limit - 1, axis=1)[:, limit - 1]
        row, col = np.nonzero(d <= farthest[:, None])  # with all ties at the boundary
        value = d[row, col]
        order = np.lexsort((col, value, row))  # among equal distances the smaller id
        row = row[order]
        held = order[np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row] < limit]
        place, near = col[held].reshape(len(q), limit), value[held].reshape(len(q), limit)
        reach = np.maximum(np.maximum(self.core[place], near[:, own_at, None]), near)
        pick = reach.argmin(axis=1)
        best = reach[np.arange(len(q)), pick]
        return place[np.arange(len(q)), pick], density_at(best), near[:, 0]

    def reach(self) -> tuple[int, int]:
        """How many neighbours are looked at, and the place of a query's own core distance among them."""
        n = len(self.ids)
        limit = max(1, min(2 * self.samples, n))
        return limit, min(self.samples, n - 1, limit - 1)

    def label(self, neighbour: np.ndarray, density: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labels and probabilities by connecting neighbours and the densities there."""
        cluster = self.point_cluster[neighbour]
        if not len(self.clusters):
            return np.full(len(cluster), -1), np.zeros(len(cluster))
        going = self.point_density[neighbour] > density
        while True:
            going &= (cluster > self.root) & (self.birth[cluster] >= density)
            if not going.any():
                break
            cluster[going] = self.up[cluster[going]]
        label, top = self.label_of[cluster], self.peak_of[cluster]
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.where(top <= 0, 1.0, np.minimum(top, density) / top)
        return label, np.where(label < 0, 0.0, share)

    def heights(self, cluster: np.ndarray, density: np.ndarray) -> np.ndarray:
        """Density at which points of each ``cluster`` meet each selected cluster; their own where one lies above the other."""
        met, place = np.unique(cluster, return_inverse=True)
        table = np.full((len(met), len(self.clusters)), -1.0)
        for row, x in zip(table, met.tolist(), strict=True):
            while (p := int(self.up[x])) >= 0:  # selected clusters below p, but not at or below x
                row[self.begin[p] + (self.label_of[p] >= 0 and self.clusters[self.label_of[p]] == p) : self.begin[x]] = self.birth[x]
                row[self.begin[x] + self.under[x] : self.begin[p] + self.under[p]] = self.birth[x]
                x = p
        h = table[:, self.turn][place]
        return np.where(h < 0, density[:, None], h)

    def closeness(self, q: np.ndarray) -> np.ndarray:
        """Share of each selected cluster in the inverse distances to the nearest exemplar."""
        k = len(self.clusters)
        least, some = np.full((len(q), k), np.inf), self.counts > 0
        if some.any():
            least[:, some] = np.minimum.reduceat(self.metric.kernel(q, self.exemplars), (np.cumsum(self.counts) - self.counts)[some], axis=1)
        with np.errstate(divide="ignore", over="ignore"):
            near = np.where(least == 0, _MAX / k, np.divide(1.0, least, out=np.full_like(least, _MAX / k), where=least > 0))
        return near / near.sum(axis=1, keepdims=True)

    def spread(self, closeness: np.ndarray, cluster: np.ndarray, density: np.ndarray, fitted: bool) -> np.ndarray:
        """Memberships of points, a row each, in each selected cluster."""
        h = self.heights(cluster, density)
        top = self.own[cluster][:, None]
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            if fitted:
                away = np.where(h <= 0, 1.0, np.exp(np.exp(-(top + 1e-8) / np.where(h > 0, h, 1.0))))
                share = closeness * (away / away.sum(axis=1, keepdims=True))
            else:
                gap = top - h
                away = top / np.where(gap > 0, gap, 1e-8)
                away = np.exp(away - away.max(axis=1, keepdims=True))
                share = np.sqrt(closeness) * (away / away.sum(axis=1, keepdims=True)) ** 2
            best = h.argmax(axis=1)
            strength = h[np.arange(len(h)), best] / np.maximum(np.maximum(self.own[self.clusters[best]], density), 1e-8)
            total = share.sum(axis=1, keepdims=True)
            return np.where(total > 0, share / total * strength[:, None], share)


def walk(up: np.ndarray, root: int, chosen: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the selected clusters at or below each cluster begin in a walk from the root, how many they are, and the place of each in that walk."""
    under, begin = np.zeros(len(up), np.int64), np.zeros(len(up), np.int64)
    under[chosen] = 1
    own = under.copy()
    for c in range(len(up) - 1, root, -1):  # children have larger ids than their parents
        under[up[c]] += under[c]
    following = np.zeros(len(up), np.int64)
    following[root] = own[root]
    for c in range(root + 1, len(up)):
        begin[c] = following[up[c]]
        following[up[c]] += under[c]
        following[c] = begin[c] + own[c]
    return begin, under, begin[chosen] if chosen else np.zeros(0, np.int64)


class Predictor:
    def __init__(self, lookup: Lookup, df: DataFrame, core: DataFrame, model):
        self.df, self.core, self.shape, self.config, self.lookup = df, core, model.shape, model.config, lookup
        self.columns = model.shape.columns
        self.held = df.sparkSession.sparkContext.broadcast(lookup)

    @classmethod
    def of(cls, model) -> Predictor:
        """From a fit. Its ids and tree go with each task; its vectors do so if they have ``SENT_BYTES`` at most, else only the exemplars' do."""
        shape, config, tree = model.shape, model.config, model.tree
        if model.near is not None:
            core = model.near.where(F.col("rank") == min(config.min_samples, shape.rows)).select("id", F.col("distance").alias("core"))
        else:
            core = neighbors.prediction_core_distances(model.vectors, config.min_samples, config.metric, shape, config.block_rows)
            if shape.rows > cells.LEAST_ROWS:
                core = stored(core)
        sent = shape.rows * shape.columns * 8 <= SENT_BYTES
        held = model.vectors.join(core, "id").select("id", "features", "core") if sent else model.vectors.select("id")
        table = held.toArrow()
        order = np.argsort(table.column("id").to_numpy())
        point_ids = table.column("id").to_numpy()[order]
        x = _rows(table, shape.columns)[order] if sent else None
        ids = max(int(tree.parent.max()), int(tree.child.max())) + 1
        chosen = choose(tree, stabilities(tree), config.extraction)
        own = own_peak(tree, ids)
        over = nearest_chosen(tree, chosen, ids)
        number = {c: i for i, c in enumerate(chosen)}
        up, birth = np.full(ids, -1), np.full(ids, -np.inf)
        big = tree.size > 1
        up[tree.child[big]], birth[tree.child[big]] = tree.parent[big], tree.density[big]
        point_cluster, point_density = np.zeros(tree.n, np.int64), np.zeros(tree.n)
        point_cluster[tree.child[~big]], point_density[tree.child[~big]] = tree.parent[~big], tree.density[~big]
        inner = set(tree.parent[big].tolist())
        tip = (~big) & (tree.density == own[tree.parent]) & ~np.isin(tree.parent, list(inner))
        tip &= over[tree.parent] >= 0
        tips, tip_label = tree.child[tip], np.array([number.get(int(c), -1) for c in over])[tree.parent[tip]]
        tips, tip_label = (v[np.argsort(tip_label, kind="stable")] for v in (tips, tip_label))
        if sent:
            exemplars = x[tips]
        else:
            named = df_of_ids(model.vectors.sparkSession, point_ids[tips])
            mine = model.vectors.join(F.broadcast(named), "id").select("id", "features").toArrow()
            at = dict(zip(mine.column("id").to_pylist(), _rows(mine, shape.columns), strict=True))
            exemplars = np.array([at[i] for i in point_ids[tips].tolist()]).reshape(-1, shape.columns)
        exemplars, tip_label = _once(exemplars, tip_label)
        lookup = Lookup(
            point_ids, x, table.column("core").to_numpy()[order] if sent else None, min(config.min_samples, shape.rows - 1), config.metric, int(tree.parent[0]), np.array(chosen, np.int64),
            np.array([number.get(int(c), -1) for c in over]), np.where(over >= 0, own[over], 0.0), own, subtree_peak(tree, ids), up, birth, point_cluster, point_density,
            exemplars, np.bincount(tip_label, minlength=len(chosen)), *walk(up, int(tree.parent[0]), chosen),
        )
        return cls(lookup, model.vectors, core, model)

    def apply(self, df: DataFrame, work: Callable[..., Iterator[pa.RecordBatch]], schema: str, step: int = 256, deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """``work``, ``step`` rows at a time, on the ids, vectors, connecting neighbours, densities there and least distances of each batch; streams can't be counted, so their vectors are checked in the task."""
        if not df.isStreaming:
            vectors.validate(df, columns=self.columns)
        held, columns = self.held, self.columns
        rows = df.select(F.col("id").cast("long"), F.col("features").cast("array<double>"))
        in_cells = self.shape.rows > cells.LEAST_ROWS and cells.serves(self.config.metric, columns)  # only some of the fitted vectors are met there
        joined = self.lookup.x is None or (in_cells and not df.isStreaming)
        if joined:
            if df.isStreaming:
                raise PredictionUnsupported("a stream is scored against vectors that go with the task, and these are too large")
            rows = self.connected(rows)
        if not df.isStreaming:
            rows = (deal or _dealt)(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look = held.value
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    q = part.column(1).flatten().to_numpy(zero_copy_only=False)
                    if len(q) != part.num_rows * columns or not np.isfinite(q).all():
                        raise ValueError(f"vectors have to hold {columns} finite values")
                    q = q.reshape(-1, columns)
                    if joined:
                        nbr, best, least = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                        found = np.searchsorted(look.ids, nbr), density_at(best), least
                    else:
                        found = look.nearest(q)
                    yield from work(look, part.column(0).to_numpy(zero_copy_only=False), q, *found)

        return rows.mapInArrow(run, schema)

    def connected(self, rows: DataFrame) -> DataFrame:
        """id, features, nbr, reach, least: the connecting neighbour by a join with all fitted vectors."""
        limit, own_at = self.lookup.reach()
        rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "id", "features"))  # asked ids may repeat
        near = neighbors.knn(rows.select(F.col("row").alias("id"), "features"), self.df, limit, self.config.metric, self.shape, keep_self=True, block_rows=self.config.block_rows)
        near = stored(near.withColumnRenamed("id", "row").join(self.core.withColumnRenamed("id", "nbr"), "nbr"))
        own = near.groupBy("row").agg(F.max(F.when(F.col("rank") == own_at + 1, F.col("distance"))).alias("own"), F.min("distance").alias("least"))
        reach = F.greatest("core", "own", "distance")
        best = near.join(own, "row").groupBy("row", "least").agg(F.min(F.struct(reach.alias("reach"), "rank", "nbr")).alias("best"))
        return rows.join(best, "row").select("id", "features", "best.nbr", "best.reach", "least")

    def predict(self, df: DataFrame) -> DataFrame:
        """(id, label, probability)."""

        def work(look: Lookup, ids: np.ndarray, q: np.ndarray, neighbour: np.ndarray, density: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
            label, probability = look.label(neighbour, density)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label.astype(np.int32)), pa.array(probability)], names=["id", "label", "probability"])

        return self.apply(df, work, "id long, label int, probability double")

    def scores(self, df: DataFrame) -> DataFrame:
        """(id, outlier_score): negative where a point is denser than the fit's peak."""

        def work(look: Lookup, ids: np.ndarray, q: np.ndarray, neighbour: np.ndarray, density: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
            density = np.where(least == 0, look.point_density[neighbour], density)
            top = look.peak[look.point_cluster[neighbour]]
            score = np.divide(top - density, top, out=np.zeros(len(q)), where=top > 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(score if len(look.clusters) else np.ones(len(q)))], names=["id", "outlier_score"])

        return self.apply(df, work, "id long, outlier_score double")

    def membership(self, df: DataFrame) -> DataFrame:
        """(id, label, membership): a row for each selected cluster."""
        return _by_label(self.membership_vectors(df))

    def membership_vectors(self, df: DataFrame) -> DataFrame:
        """(id, memberships): a row for each point, its membership in each selected cluster at the place of the label."""

        def work(look: Lookup, ids: np.ndarray, q: np.ndarray, neighbour: np.ndarray, density: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
            density = np.minimum(look.point_density[neighbour], density)
            yield from _packed(look, ids, q, look.point_cluster[neighbour], density, fitted=False)

        return _each_point(self.apply(df, work, _PACKED, deal=_equals_together))

    def all_points_membership(self) -> DataFrame:
        """(id, label, membership) of the fitted points."""
        return _by_label(self.all_points_membership_vectors())

    def all_points_membership_vectors(self) -> DataFrame:
        """(id, memberships) of the fitted points."""
        held, columns = self.held, self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look = held.value
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                place = np.searchsorted(look.ids, ids)
                q = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)
                yield from _packed(look, ids, q, look.point_cluster[place], look.point_density[place], fitted=True)

        return _each_point(_equals_together(self.df.select("id", "features")).mapInArrow(run, _PACKED))


def _rows(table: pa.Table, columns: int) -> np.ndarray:
    return table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)


def df_of_ids(spark: SparkSession, ids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(i),) for i in np.unique(ids)], "id long")


def _once(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal vectors of a label once, by label."""
    if not len(x):
        return x, label
    _, at = np.unique(np.column_stack([label.astype(float), x]), axis=0, return_index=True)
    at = at[np.argsort(label[at], kind="stable")]
    return x[at], label[at]


def _dealt(rows: DataFrame) -> DataFrame:
    """Over all cores: small files of many rows come as few partitions."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _equals_together(rows: DataFrame) -> DataFrame:
    """Over all cores, equal vectors beside each other; those of very many rows are parted by id."""
    return rows.repartitionByRange(4 * rows.sparkSession.sparkContext.defaultParallelism, "features", "id").sortWithinPartitions("features", "id")


#: The ids of points alike, and their memberships by label.
_PACKED = "ids array<long>, memberships array<double>"
#: Distances or memberships that a task holds at once.
_VALUES = 1 << 20


def _alike(look: Lookup, q: np.ndarray, cluster: np.ndarray, density: np.ndarray, fitted: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of points ordered by what counts, where each group of points alike begins and ends among them, and its memberships; so many groups at once as ``_VALUES`` allow."""
    k = len(look.clusters)
    if not k or not len(q):
        return
    step = max(1, _VALUES // max(k, len(look.exemplars)))
    _, first, alike = np.unique(np.column_stack([q, cluster, density]), axis=0, return_index=True, return_inverse=True)
    order = np.argsort(alike, kind="stable")
    ends = np.searchsorted(alike[order], np.arange(len(first) + 1))
    for at in range(0, len(first), step):
        one = first[at : at + step]
        values = look.spread(look.closeness(q[one]), cluster[one], density[one], fitted)
        yield order[ends[at] : ends[at + len(one)]], ends[at : at + len(one) + 1] - ends[at], values


def _packed(look: Lookup, ids: np.ndarray, q: np.ndarray, cluster: np.ndarray, density: np.ndarray, fitted: bool) -> Iterator[pa.RecordBatch]:
    """A row for points alike, which leave the task once; without clusters all points are."""
    if not len(look.clusters):
        yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([[]], pa.list_(pa.float64()))], names=["ids", "memberships"])
    for points, ends, values in _alike(look, q, cluster, density, fitted):
        k = values.shape[1]
        columns = (ends, ids[points]), (np.arange(len(values) + 1) * k, values.ravel())
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v)) for at, v in columns], names=["ids", "memberships"])


def _each_point(rows: DataFrame) -> DataFrame:
    """(id, memberships) of packed rows."""
    return rows.select(F.explode("ids").alias("id"), "memberships")


def _by_label(rows: DataFrame) -> DataFrame:
    """(id, label, membership) of rows of (id, memberships)."""
    return rows.select("id", F.posexplode("memberships").alias("label", "membership"))


def _memberships(look: Lookup, ids: np.ndarray, q: np.ndarray, cluster: np.ndarray, density: np.ndarray, fitted: bool) -> Iterator[pa.RecordBatch]:
    """Like ``_packed``, a row for each point and selected cluster, so many at once as ``_VALUES`` allow."""
    k = len(look.clusters)
    for points, ends, values in _alike(look, q, cluster, density, fitted):
        group = np.repeat(np.arange(len(values)), np.diff(ends))
        step = max(1, _VALUES // max(k, len(look.exemplars)))
        for at in range(0, len(points), step):
            part = points[at : at + step]
            columns = np.repeat(ids[part], k), np.tile(np.arange(k, dtype=np.int32), len(part)), values[group[at : at + step]].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "label", "membership"])
