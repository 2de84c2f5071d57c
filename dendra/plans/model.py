"""Fitting: from vectors, a distance matrix or a graph to a hierarchy and flat clusters.

What grows with the data (neighbours, reachability, spanning-tree candidates, scoring)
runs distributed; the merge of n - 1 tree edges runs in one task, and its rows come back
as one DataFrame that holds all trees and results by kind.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BranchDataMissing, BranchUnsupported, DendraError, Disconnected, InsufficientNeighbors, InvalidConfig, InvalidDistance, PredictionDataMissing, PredictionUnsupported
from ..functions.metrics import Metric, by_products, metric_of
from ..operators import adjacency, approximate, cells, neighbors, spanning
from ..operators.tree import Condensed, Edges, condense, connected, extract, kruskal, linkage, outliers, prim
from ..sources import exports, graphs, vectors
from .config import APPROXIMATE, AUTO, BRUTE, KDTREE, Config, ExtractionConfig
from .lineage import stored

#: kind, place, two ids, two numbers, a size: one schema for all rows of a fit.
ROW = "kind string, seq long, a long, b long, x double, y double, n long"
_KINDS = pa.schema([("kind", pa.string()), ("seq", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("n", pa.int64())])
_KD_COLUMNS = 32


def _part(kind: str, seq, a, b, x, y, n) -> pa.Table:
    size = len(seq)
    columns = [pa.array([kind] * size, pa.string())]
    for values, kind_of in zip((seq, a, b, x, y, n), (np.int64, np.int64, np.int64, np.float64, np.float64, np.int64), strict=True):
        columns.append(pa.array(np.broadcast_to(np.asarray(values, kind_of), size)))
    return pa.Table.from_arrays(columns, schema=_KINDS)


def flat_rows(ids: np.ndarray, tree: Condensed, config: ExtractionConfig) -> list[pa.Table]:
    flat = extract(tree, config)
    order = np.arange(len(ids))
    return [
        _part("point", order, ids, flat.labels, flat.probabilities, outliers(tree), 0),
        _part("cluster", np.arange(len(flat.clusters)), np.arange(len(flat.clusters)), flat.clusters, flat.persistence, flat.stability[flat.clusters] if len(flat.clusters) else [], 0),
    ]


def tree_rows(ids: np.ndarray, edges: Edges, config: Config) -> pa.Table:
    """Everything that follows from a spanning tree whose edges are in tie order."""
    n = len(ids)
    ordered = edges.ordered()
    link = linkage(n, ordered)
    tree = condense(link, config.min_cluster_size)
    merges = np.arange(n - 1)
    return pa.concat_tables(
        [
            _part("mst", merges, ids[ordered.src], ids[ordered.dst], ordered.distance, 0, 0),
            _part("linkage", merges, link.left, link.right, link.distance, 0, link.size),
            _part("condensed", np.arange(len(tree.parent)), tree.parent, tree.child, tree.density, 0, tree.size),
            *flat_rows(ids, tree, config.extraction),
        ]
    )


def _single_task(df: DataFrame, run, schema: str = ROW) -> DataFrame:
    """All rows in one task: only behind a check of their number, or for the n - 1 edges of a tree."""
    return df.groupBy().applyInArrow(run, schema)


def select_algorithm(df: DataFrame, metric: Metric | str | None = None) -> str:
    """The strategy's name under auto: kdtree for low Euclidean dimensions with spread, bruteforce else.

    It is reported, and gives the same neighbours. Vectors too many to broadcast are cut
    into cells of space wherever the metric and the dimensions allow (see ``cells``).
    """
    metric = metric_of(metric)
    shape = vectors.validate(df)
    return _auto(df, metric, shape)


def _auto(df: DataFrame, metric: Metric, shape: vectors.Shape) -> str:
    if metric.name != "euclidean" or not 0 < shape.columns <= _KD_COLUMNS or shape.rows < 32:
        return BRUTE
    spread = df.select(F.posexplode("features")).groupBy("pos").agg((F.max("col") > F.min("col")).cast("int").alias("wide")).agg(F.sum("wide")).first()[0]
    return BRUTE if spread * 4 < shape.columns else KDTREE


@dataclass
class FittedModel:
    """A fit. DataFrames are derived from one persisted set of rows."""

    rows: DataFrame
    config: Config
    size: int
    algorithm: str
    approximate: bool = False
    workers: int = 0
    vectors: DataFrame | None = None
    shape: vectors.Shape | None = None
    cache: dict = field(default_factory=dict)
    #: (id, rank, nbr, distance): of each point one neighbour more than ``min_samples``, itself counted, where their search is worth keeping.
    near: DataFrame | None = None

    def _kind(self, kind: str, **names: str) -> DataFrame:
        return self.rows.where(F.col("kind") == kind).select(*(F.col(v).alias(k) for k, v in names.items()))

    @property
    def mst(self) -> DataFrame:
        """seq, src, dst, distance: by distance, ties in the order the tree grew."""
        return self._kind("mst", seq="seq", src="a", dst="b", distance="x")

    @property
    def linkage(self) -> DataFrame:
        """node, left, right, distance, size; ids are places of points in the order of their ids, merges from there on."""
        return self._kind("linkage", seq="seq", left="a", right="b", distance="x", size="n").withColumn("node", F.col("seq") + self.size)

    @property
    def condensed(self) -> DataFrame:
        return self._kind("condensed", seq="seq", parent="a", child="b", lambda_val="x", child_size="n")

    @property
    def points(self) -> DataFrame:
        return self._kind("point", id="a", label="b", probability="x", outlier_score="y").withColumn("label", F.col("label").cast("int"))

    @property
    def clusters(self) -> DataFrame:
        return self._kind("cluster", label="a", cluster_id="b", persistence="x", stability="y").withColumn("label", F.col("label").cast("int"))

    @property
    def labels(self) -> DataFrame:
        return self.points.select("id", "label")

    def cluster_count(self) -> int:
        return self.clusters.count()

    @cached_property
    def tree(self) -> Condensed:
        """The condensed tree on the driver: as many rows as points and clusters; for post-processing by kernels."""
        t = self.condensed.orderBy("seq").toArrow()
        return Condensed(self.size, *(t.column(c).to_numpy() for c in ("parent", "child", "lambda_val", "child_size")))

    def extract(self, config: ExtractionConfig) -> tuple[DataFrame, DataFrame]:
        """(points, clusters) chosen anew from the tree; no distances. Options that aren't given take their defaults, not the fit's."""
        config = config.validated()
        n = self.size

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("seq")
            kind = table.column("kind").to_numpy(zero_copy_only=False)
            a, b, x, size = (table.column(c).to_numpy() for c in ("a", "b", "x", "n"))
            c = kind == "condensed"
            return pa.concat_tables(flat_rows(a[kind == "point"], Condensed(n, a[c], b[c], x[c], size[c]), config))

        again = replace(self, rows=_single_task(self.rows.where("kind IN ('condensed', 'point')"), run).persist(), cache={})
        return again.points, again.clusters

    def export(self, kind: str, path: str, form: str = exports.CSV) -> None:
        exports.write({"mst": self.mst, "linkage": self.linkage, "condensed": self.condensed}[kind], kind, path, form)

    def predictor(self) -> Any:
        from ..operators.prediction import Predictor

        if not self.config.prediction_data or self.vectors is None:
            raise PredictionDataMissing("fit with prediction_data")
        if "predictor" not in self.cache:
            self.cache["predictor"] = Predictor.of(self)
        return self.cache["predictor"]

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predictor().predict(df)

    def predict_scores(self, df: DataFrame) -> DataFrame:
        return self.predictor().scores(df)

    def membership(self, df: DataFrame) -> DataFrame:
        return self.predictor().membership(df)

    def all_points_membership(self) -> DataFrame:
        return self.predictor().all_points_membership()

    def membership_vectors(self, df: DataFrame) -> DataFrame:
        """(id, memberships): what ``membership`` gives, a row for each point."""
        return self.predictor().membership_vectors(df)

    def all_points_membership_vectors(self) -> DataFrame:
        return self.predictor().all_points_membership_vectors()

    def detect_branches(self, config: Any = None, labels: DataFrame | None = None) -> Any:
        from ..operators.branches import detect
        from .config import BranchConfig

        if not self.config.branch_data or self.vectors is None:
            raise BranchDataMissing("fit with branch_data")
        return detect(self, config or BranchConfig(), labels)

    def unpersist(self) -> None:
        self.rows.unpersist()


class Clusterer:
    """A validated configuration; fits don't change it."""

    def __init__(self, config: Config | None = None, **options: Any):
        self.config = (config or Config(**options)).validated()

    def fit(self, df: DataFrame) -> FittedModel:
        return fit(df, self.config)

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return fit(df, self.config).labels


def _checked(rows: DataFrame) -> DataFrame:
    """Persisted and computed, so that errors of the kernel surface here, by their kinds."""
    rows = rows.persist()
    try:
        rows.count()
    except Exception as error:
        rows.unpersist()
        for kind in (Disconnected, InsufficientNeighbors, InvalidDistance):
            if f"{kind.__name__}:" in str(error):
                raise kind(str(error).split(f"{kind.__name__}:")[1].splitlines()[0].strip()) from None
        raise
    return rows


def fit(df: DataFrame, config: Config | None = None) -> FittedModel:
    """Clusters of (id, features)."""
    config = (config or Config()).validated()
    shape = vectors.validate(df)
    config = config.validated(shape.rows)
    metric, n, kept = config.metric, shape.rows, None
    if config.workers:
        df = df.repartition(min(config.workers, n), "id")
    if config.algorithm == APPROXIMATE:
        rows = approximate.fit_rows(df, config, shape)
        name = APPROXIMATE
    else:
        k, near = min(config.min_samples, n - 1), None
        if n > config.prim_rows and by_products(metric, shape.columns) and not cells.serves(metric, shape.columns):
            near = stored(neighbors.knn(df, df, k, metric, shape, block_rows=config.block_rows))
            core = near.where(F.col("rank") == k).select("id", F.col("distance").alias("core"))
        elif n > cells.LEAST_ROWS and cells.serves(metric, shape.columns) and (config.prediction_data or config.branch_data):
            kept = stored(neighbors.knn(df, df, k + 1, metric, shape, keep_self=True, block_rows=config.block_rows))
            core = kept.where(F.col("rank") == k + 1).select("id", F.col("distance").alias("core"))  # a point is at no distance of itself
        else:
            core = neighbors.core_distances(df, k, metric, shape, config.block_rows)
        points = df.join(core, "id")
        name = config.algorithm
        if name == AUTO:
            name = _auto(df, metric, shape)
        if n <= config.prim_rows:
            rows = _single_task(points, _prim_kernel(config, metric, shape.columns))
        else:
            points = stored(points)
            if near is None:
                edges = spanning.block_candidates(points, metric, config.alpha, shape.columns, n, config.block_rows)
            else:
                edges = spanning.ordered_candidates(points, near, metric, config.alpha, shape, k)
            rows = _single_task(edges.withColumn("n", F.lit(n)).unionByName(df.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("distance"), F.lit(n).alias("n"))), edge_kernel(config))
    return FittedModel(_checked(rows), config, n, name, name == APPROXIMATE, config.workers, df if config.prediction_data or config.branch_data else None, shape, near=kept)


def _prim_kernel(config: Config, metric: Metric, columns: int):
    def run(table: pa.Table) -> pa.Table:
        ids, core = table.column("id").to_numpy(), table.column("core").to_numpy()
        order = np.argsort(ids)
        ids, core = ids[order], core[order]
        x = table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)[order]

        held: list[np.ndarray] = [ids[:0], x, core]

        def reach(i: int, others: np.ndarray) -> np.ndarray:
            if held[0] is not others:
                held[:] = others, np.asfortranarray(x[others]), core[others]
            d = metric.kernel(x[i : i + 1], held[1])[0]
            return np.maximum(d / config.alpha if config.alpha != 1 else d, np.maximum(core[i], held[2]))

        return tree_rows(ids, prim(len(ids), reach), config)

    return run


def edge_kernel(config: Config):
    """From edges, and rows without dst that name the vertices: Kruskal in the order (distance, smaller id, larger id)."""
    config = replace(config, approximate_backend=None)  # stays on the driver

    def run(table: pa.Table) -> pa.Table:
        lone = np.asarray(table.column("dst").is_null())
        src = table.column("src").to_numpy()
        ids = np.sort(src[lone])
        at = ~lone
        a = np.searchsorted(ids, src[at])
        b = np.searchsorted(ids, table.column("dst").filter(pa.array(at)).to_numpy())
        d = table.column("distance").to_numpy()[at]
        return tree_rows(ids, connected(len(ids), kruskal(len(ids), a, b, d)), config)

    return run


def fit_predict(df: DataFrame, config: Config | None = None) -> DataFrame:
    """(id, label) of a fit that isn't kept."""
    return fit(df, config).labels


def fit_precomputed(edges: DataFrame, n: int, config: Config | None = None) -> FittedModel:
    """Clusters of a complete symmetric distance matrix as edges; infinite distances are missing ones."""
    config = _without_vectors(config, n)
    graphs.validate(edges, n, dense=True)

    def run(table: pa.Table) -> pa.Table:
        d = np.full((n, n), np.inf)
        d[table.column("src").to_numpy(), table.column("dst").to_numpy()] = table.column("distance").to_numpy()
        core = np.sort(d, axis=1)[:, min(config.min_samples, n - 1)]
        return tree_rows(np.arange(n), prim(n, lambda i, o: np.maximum(d[i, o] / config.alpha, np.maximum(core[i], core[o]))), config)

    return FittedModel(_checked(_single_task(edges, run)), config, n, "reference")


def fit_graph(edges: DataFrame, n: int, config: Config | None = None) -> FittedModel:
    """Clusters of a sparse symmetric graph; absent edges stay absent, at any size the work is on the edges alone."""
    config = _without_vectors(config, n)
    graphs.validate(edges, n, dense=False)
    k = min(config.min_samples, n - 1)
    core = neighbors.graph_core_distances(edges, k)
    ids = edges.sparkSession.range(n)
    lacking = ids.join(core, "id", "left").where(F.col("core").isNull()).orderBy("id").limit(1).collect()
    if lacking:
        raise InsufficientNeighbors(f"vertex {lacking[0]['id']} has {lacking[0]['stored'] or 0} neighbours, {k} are needed")
    upper = edges.where("src < dst").join(core.select(F.col("id").alias("src"), F.col("core").alias("core_a")), "src").join(core.select(F.col("id").alias("dst"), F.col("core").alias("core_b")), "dst")
    reach = upper.select("src", "dst", neighbors.reachability(F.col("distance"), F.col("core_a"), F.col("core_b"), config.alpha).alias("distance"))
    named = reach.unionByName(ids.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("distance")))
    return FittedModel(_checked(_single_task(named, edge_kernel(config))), config, n, "sparse")


#: Bytes of a matrix that one task holds at most; beyond, its tree is found row by row and ties go by id.
MATRIX_BYTES = 1 << 29


def fit_matrix(rows: graphs.Rows, n: int, config: Config | None = None) -> FittedModel:
    """Like ``fit_precomputed``, of a matrix that comes by rows."""
    config = _without_vectors(config, n)
    k = min(config.min_samples, n - 1)
    found = adjacency.summary(rows, n, k, dense=True)
    if n * n * 8 > MATRIX_BYTES:
        return _of_rows(rows, found, n, config, "reference")
    read, core = rows.read, found.core

    def pack(batches):
        for i, _, d in read(batches):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([d.tobytes()], pa.binary())], names=["id", "row"])

    def run(table: pa.Table) -> pa.Table:
        d = np.empty((n, n))
        for batch in table.to_batches():
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                d[i] = np.frombuffer(row.as_buffer())
        return tree_rows(np.arange(n), prim(n, lambda i, o: np.maximum(d[i, o] / config.alpha, np.maximum(core[i], core[o]))), config)

    return FittedModel(_checked(_single_task(rows.df.mapInArrow(pack, "id long, row binary"), run)), config, n, "reference")


def fit_graph_rows(rows: graphs.Rows, n: int, config: Config | None = None) -> FittedModel:
    """Like ``fit_graph``, of a graph that comes by rows; no task holds more than a few of them and a forest."""
    config = _without_vectors(config, n)
    return _of_rows(rows, adjacency.summary(rows, n, min(config.min_samples, n - 1), dense=False), n, config, "sparse")


def _of_rows(rows: graphs.Rows, found: adjacency.Summary, n: int, config: Config, name: str) -> FittedModel:
    edges = adjacency.tree_edges(rows, found, config.alpha)
    ids = edges.sparkSession.range(n).select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("distance"))
    return FittedModel(_checked(_single_task(edges.unionByName(ids), edge_kernel(config))), config, n, name)


def _without_vectors(config: Config | None, n: int) -> Config:
    config = copy.copy(config or Config()).validated(n)
    if config.prediction_data:
        raise PredictionUnsupported("there are no vectors to predict from")
    if config.branch_data:
        raise BranchUnsupported("there are no vectors to find branches in")
    return config


__all__ = ["Clusterer", "FittedModel", "fit", "fit_graph", "fit_graph_rows", "fit_matrix", "fit_precomputed", "fit_predict", "select_algorithm", "DendraError", "InvalidConfig"]
