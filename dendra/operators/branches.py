"""Branches inside clusters: one task for each cluster, a window for the labels' offsets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Disconnected, InvalidConfig
from ..functions.metrics import Metric
from ..plans.config import CORE, BranchConfig, contiguous
from ..sources import exports
from . import neighbors
from .tree import condense, extract, kruskal, linkage

_ROW = "kind string, cluster int, seq long, a long, b long, x double, y double, n long"
_SCHEMA = pa.schema([("kind", pa.string()), ("cluster", pa.int32()), ("seq", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("n", pa.int64())])


def pack_edge(src: Column, dst: Column) -> Column:
    """Both ends, 32 bits each, in one long: the smaller id in the high half."""
    return F.shiftleft(F.least(src, dst), 32).bitwiseOR(F.greatest(src, dst).bitwiseAND(0xFFFFFFFF))


def unpack_edge(packed: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, 32), packed.bitwiseAND(0xFFFFFFFF)


def _rows(kind: str, cluster: int, seq, a=0, b=0, x=0.0, y=0.0, n=0) -> pa.Table:
    size = len(seq)
    numbers = [np.broadcast_to(np.asarray(v, k), size) for v, k in zip((seq, a, b, x, y, n), (np.int64, np.int64, np.int64, np.float64, np.float64, np.int64), strict=True)]
    return pa.Table.from_arrays([pa.array([kind] * size, pa.string()), pa.array([cluster] * size, pa.int32()), *map(pa.array, numbers)], schema=_SCHEMA)


def centrality(x: np.ndarray, weight: np.ndarray, metric: Metric) -> np.ndarray:
    """Inverse distance to the weighted centre; the plain centre where all weights are zero."""
    total = weight.sum()
    center = (weight[:, None] * x).sum(axis=0) / total if total else x.mean(axis=0)
    d = metric.kernel(x, center[None, :])[:, 0]
    return np.divide(1.0, d, out=np.full(len(d), np.inf), where=d > 0)


def _graph(ids: np.ndarray, x: np.ndarray, core: np.ndarray, lists: np.ndarray, tree: np.ndarray, central: np.ndarray, metric: Metric, method: str) -> tuple[np.ndarray, ...]:
    """Edges (a, b, centrality, reach) between places, a < b, in order."""
    at = {int(v): i for i, v in enumerate(ids)}
    inside = [(at[int(s)], at[int(t)], d) for s, t, d in tree if int(s) in at and int(t) in at]
    found: dict[tuple[int, int], float] = {}

    def add(a: int, b: int, reach: float) -> None:
        pair = (min(a, b), max(a, b))
        if a != b and reach < found.get(pair, np.inf):
            found[pair] = reach

    if method == CORE:
        for a, b, d in inside:
            add(a, b, d)
        for i, row in enumerate(lists):
            local = np.array([at[int(q)] for q in row if int(q) in at and at[int(q)] != i], np.int64)
            if len(local):
                reach = np.maximum(metric.kernel(x[i : i + 1], x[local])[0], np.maximum(core[i], core[local]))
                for j, r in zip(local.tolist(), reach.tolist(), strict=True):
                    add(i, j, r)
        pairs = sorted(found)
        a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        reach = np.array([found[p] for p in pairs])
    else:
        most = max((d for *_, d in inside), default=0.0)
        parts = []
        for i in range(len(ids) - 1):  # row by row: never all pairs at once
            r = np.maximum(metric.kernel(x[i : i + 1], x[i + 1 :])[0], np.maximum(core[i], core[i + 1 :]))
            j = np.flatnonzero(r <= most)
            parts.append((np.full(len(j), i), j + i + 1, r[j]))
        a, b, reach = (np.concatenate([p[k] for p in parts]) for k in range(3))
    return a, b, np.maximum(central[a], central[b]), reach


def _cluster_kernel(config: BranchConfig, metric: Metric, columns: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        cluster = key[0].as_py()
        edge = np.asarray(table.column("edge"))
        points = table.filter(pa.array(~edge)).sort_by("id")
        tree = np.array([table.column(c).filter(pa.array(edge)).to_numpy() for c in ("id", "other", "core")]).T
        ids, core, weight = (points.column(c).to_numpy() for c in ("id", "core", "weight"))
        x = points.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)
        n = len(ids)
        if n < 2:
            return _rows("point", cluster, [0], ids, -2, 0, 1.0) if n else _SCHEMA.empty_table()
        lists = points.column("nbrs").to_pylist()
        central = centrality(x, weight, metric)
        a, b, c, reach = _graph(ids, x, core, lists, tree, central, metric, config.graph)
        spanning = kruskal(n, a, b, c, keys=(reach,))
        if len(spanning.src) != n - 1:
            raise Disconnected(f"{Disconnected.__name__}: the branch graph of cluster {cluster} isn't connected")
        order = np.lexsort((spanning.dst, spanning.src, spanning.distance))
        spanning = type(spanning)(spanning.src[order], spanning.dst[order], spanning.distance[order])
        link = linkage(n, spanning)
        small = condense(link, config.min_cluster_size)
        flat = extract(small, config.extraction)
        merges = np.arange(n - 1)
        return pa.concat_tables(
            [
                _rows("point", cluster, np.arange(n), ids, flat.labels, central, flat.probabilities),
                _rows("graph", cluster, np.arange(len(a)), ids[a], ids[b], c, reach),
                _rows("linkage", cluster, merges, link.left, link.right, link.distance, 0, link.size),
                _rows("condensed", cluster, np.arange(len(small.parent)), small.parent, small.child, small.density, 0, small.size),
                _rows("branch", cluster, np.arange(len(flat.clusters)), np.arange(len(flat.clusters)), flat.clusters, flat.persistence),
            ]
        )

    return run


@dataclass
class BranchResult:
    model: object
    config: BranchConfig
    rows: DataFrame
    points: DataFrame

    def _kind(self, kind: str, **names: str) -> DataFrame:
        return self.rows.where(F.col("kind") == kind).select("cluster", "seq", *(F.col(v).alias(k) for k, v in names.items()))

    @property
    def graph(self) -> DataFrame:
        edges = self._kind("graph", src="a", dst="b", centrality="x", reachability="y")
        return edges.withColumn("packed", pack_edge(F.col("src"), F.col("dst")))

    @property
    def linkage(self) -> DataFrame:
        return self._kind("linkage", left="a", right="b", distance="x", size="n")

    @property
    def condensed(self) -> DataFrame:
        return self._kind("condensed", parent="a", child="b", lambda_val="x", child_size="n")

    def export(self, path: str, form: str = exports.CSV) -> None:
        """The branch graph as from, to, centrality, reachability."""
        exports.write(self.graph, "branch_graph", path, form)

    @property
    def persistences(self) -> DataFrame:
        return self._kind("branch", branch="a", persistence="x")

    def predict(self, df: DataFrame) -> DataFrame:
        """(id, label, probability, cluster_label, cluster_probability, branch_label, branch_probability) of new points, by the connecting neighbour.

        A point of a cluster that isn't split gets the cluster's own number as label.
        """
        predictor = self.model.predictor()

        def work(look, ids: np.ndarray, q: np.ndarray, neighbour: np.ndarray, density: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
            label, probability = look.label(neighbour, density)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(look.ids[neighbour]), pa.array(label.astype(np.int32)), pa.array(probability)], names=["id", "nbr", "cluster_label", "cluster_probability"])

        near = predictor.apply(df, work, "id long, nbr long, cluster_label int, cluster_probability double")
        counts = self.persistences.groupBy(F.col("cluster").alias("cluster_label")).agg(F.count("*").alias("branches"))
        own = self.points.select(F.col("id").alias("nbr"), F.col("label").alias("near_label"), F.col("branch_label").alias("near_branch"), F.col("branch_probability").alias("near_probability"))
        rows = near.join(own, "nbr").join(counts, "cluster_label", "left")
        split = (F.col("cluster_label") >= 0) & (F.coalesce("branches", F.lit(0)) > (1 if self.config.label_sides else 2))
        return rows.select(
            "id",
            F.when(split, F.col("near_label")).otherwise(F.col("cluster_label")).alias("label"),
            F.when(F.col("cluster_label") < 0, 0.0).when(split, (F.col("cluster_probability") + F.col("near_probability")) / 2).otherwise(F.col("cluster_probability")).alias("probability"),
            "cluster_label",
            "cluster_probability",
            F.when(split, F.col("near_branch")).otherwise(0).alias("branch_label"),
            F.when(split, F.col("near_probability")).otherwise(1.0).alias("branch_probability"),
        )


def detect(model, config: BranchConfig, labels: DataFrame | None = None) -> BranchResult:
    """Branches of a fit's clusters, or of ``labels`` (id, label, and perhaps probability).

    points: id, label, probability, cluster_label, cluster_probability, branch_label,
    branch_probability, centrality. Noise has label -1, branch 0 and branch probability 1.
    """
    config = config.validated(model.config)
    fit, shape = model.config, model.shape
    metric = fit.metric
    if labels is None:
        own = model.points.select("id", F.col("label").alias("cluster"), F.col("probability").alias("weight"))
    else:
        contiguous([r[0] for r in labels.select("label").distinct().collect()])
        weight = F.col("probability") if "probability" in labels.columns else F.when(F.col("label") < 0, 0.0).otherwise(1.0)
        own = labels.select("id", F.col("label").cast("int").alias("cluster"), weight.cast("double").alias("weight"))
        if own.join(model.labels, "id").count() != shape.rows or own.count() != shape.rows:
            raise InvalidConfig("cluster labels differ in length from the fitted rows")
        if own.where(F.isnan("weight") | (F.col("weight") < 0) | (F.col("weight") > 1)).limit(1).count():
            raise InvalidConfig("a cluster probability lies outside 0 and 1")
    k = min(fit.min_samples, shape.rows - 1)
    if model.near is not None:
        near = model.near.groupBy("id").agg(F.max(F.when(F.col("rank") == k + 1, F.col("distance"))).alias("core"), F.collect_list(F.when(F.col("rank") <= k, F.col("nbr"))).alias("nbrs"))
    else:
        core = neighbors.core_distances(model.vectors, fit.min_samples, metric, shape, fit.block_rows)
        lists = neighbors.knn(model.vectors, model.vectors, k, metric, shape, keep_self=True, block_rows=fit.block_rows).groupBy("id").agg(F.collect_list("nbr").alias("nbrs"))
        near = core.join(lists, "id")
    nothing = F.lit(None)
    points = own.where("cluster >= 0").join(model.vectors, "id").join(near, "id")
    points = points.select("cluster", "id", nothing.cast("long").alias("other"), "core", "weight", "features", "nbrs", F.lit(False).alias("edge"))
    ends = own.select(F.col("id").alias("src"), "cluster").join(model.mst, "src").join(own.select(F.col("id").alias("dst"), F.col("cluster").alias("c2")), "dst").where("cluster >= 0 AND cluster = c2")
    edges = ends.select("cluster", F.col("src").alias("id"), F.col("dst").alias("other"), F.col("distance").alias("core"), F.lit(0.0).alias("weight"), nothing.cast("array<double>").alias("features"), nothing.cast("array<bigint>").alias("nbrs"), F.lit(True).alias("edge"))
    from ..plans.model import _checked

    dealt = points.unionByName(edges).repartition(4 * points.sparkSession.sparkContext.defaultParallelism, "cluster")  # few bytes, but much work a cluster
    rows = _checked(dealt.groupBy("cluster").applyInArrow(_cluster_kernel(config, metric, shape.columns), _ROW))
    placed = rows.where("kind = 'point'").select("cluster", F.col("a").alias("id"), F.col("b").cast("int").alias("branch"), F.col("x").alias("centrality"), F.col("y").alias("inner"))
    branches = rows.where("kind = 'branch'").groupBy("cluster").agg(F.count("*").alias("branches"))
    state = placed.groupBy("cluster").agg(F.count("*").alias("size"), F.max((F.col("branch") == -1).cast("int")).alias("noise")).join(branches, "cluster", "left")
    many = F.coalesce("branches", F.lit(0)) > (1 if config.label_sides else 2)
    width = F.when(F.col("size") < 2, 0).when(many, F.col("branches") + F.col("noise")).otherwise(1)
    before = Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)
    offsets = state.withColumn("split", many & (F.col("size") >= 2)).withColumn("offset", F.coalesce(F.sum(width).over(before), F.lit(0)))
    inside = placed.join(offsets, "cluster")
    joined = own.join(inside.drop("cluster"), "id", "left")
    split = F.coalesce("split", F.lit(False))
    label = F.when(F.col("size").isNull() | (F.col("size") < 2), -1).when(split, F.col("branch") + F.col("offset") + F.col("noise")).otherwise(F.col("offset"))
    out = joined.select(
        "id",
        label.cast("int").alias("label"),
        F.when(split, (F.col("weight") + F.col("inner")) / 2).otherwise(F.col("weight")).alias("probability"),
        F.col("cluster").alias("cluster_label"),
        F.col("weight").alias("cluster_probability"),
        F.when(split, F.col("branch")).otherwise(0).alias("branch_label"),
        F.when(split, F.col("inner")).otherwise(1.0).alias("branch_probability"),
        F.coalesce("centrality", F.lit(0.0)).alias("centrality"),
    )
    return BranchResult(model, config, rows, out)
