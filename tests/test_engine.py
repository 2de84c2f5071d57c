"""The engine against plain versions of the same definitions, and its invariants."""

import math
import threading
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import InheritableThread
from pyspark.sql import functions as F

from dendra import errors, queries
from dendra.functions import metrics as M
from dendra.operators import adjacency, analytics, approximate, cells, evaluation, neighbors, prediction, spanning, tree
from dendra.operators.robust import cut_linkage, robust_single_linkage
from dendra.operators.validity import validity
from dendra.plans import jobs
from dendra.plans.config import BranchConfig, Config, ExtractionConfig, RobustConfig
from dendra.plans import model as models
from dendra.plans.model import Clusterer, fit, fit_graph, fit_graph_rows, fit_matrix, fit_precomputed, fit_predict, select_algorithm
from dendra.sources import exports, graphs, vectors
from dendra.sources.generators import Recipe, SplitMix, generate, manifest
from dendra.streaming.scoring import predict_stream, score_stream

A, B = np.array([[0.5, 3.0, -2.0, 7.0]]), np.array([[2.5, -1.0, 1.0, 6.0]])
GAPS = [abs(x - y) for x, y in zip(A[0], B[0], strict=True)]
KNOWN = {
    "sqeuclidean": sum(g * g for g in GAPS),
    "euclidean": math.hypot(*GAPS),
    "manhattan": sum(GAPS),
    "chebyshev": max(GAPS),
    "canberra": sum(g / (abs(x) + abs(y)) for g, x, y in zip(GAPS, A[0], B[0], strict=True)),
    "braycurtis": sum(GAPS) / sum(abs(x + y) for x, y in zip(A[0], B[0], strict=True)),
}


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>")


def labelled(spark, labels):
    return spark.createDataFrame(list(enumerate(map(int, labels))), "id long, label int")


def blobs(seed=0, n=60, d=2):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.4, (n // 3, d)) for c in (-5, 0, 5)])


def plain_fit(x, size, samples, alpha=1.0):
    """Spanning tree, merges and condensed rows from the definitions, with sets of points; no code of the engine."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(samples, n - 1)]
    reach = np.maximum(d / alpha, np.maximum(core[:, None], core[None]))
    joined, edges = [0], []
    while len(joined) < n:
        options = [(min(reach[i, j] for i in joined), j) for j in range(n) if j not in joined]
        weight, j = min(options)
        edges.append((next(i for i in joined if reach[i, j] == weight), j, weight))
        joined.append(j)
    edges = sorted(edges, key=lambda e: e[2])
    groups, merges = {i: ({i}, i) for i in range(n)}, []  # by point: its set, the set's node
    for i, j, weight in edges:
        (one, left), (two, right) = groups[i], groups[j]
        both = (one | two, n + len(merges))
        merges.append((left, right, weight, len(both[0])))
        groups.update(dict.fromkeys(both[0], both))
    points = {i: {i} for i in range(n)}
    for k, (left, right, _, _) in enumerate(merges):
        points[n + k] = points[left] | points[right]
    rows, level, number = [], [(2 * n - 2, n)], n
    while level:
        below = []
        for node, cluster in level:
            left, right, weight, _ = merges[node - n]
            lam = 1 / weight if weight > 0 else math.inf
            if min(len(points[left]), len(points[right])) >= size:
                for side in (left, right):
                    number += 1
                    rows.append((cluster, number, lam, len(points[side])))
                    below.append((side, number))
                continue
            for side in (left, right):
                if len(points[side]) >= size:
                    below.append((side, cluster))
                else:
                    rows += [(cluster, p, lam, 1) for p in points[side]]
        level = below
    return edges, merges, rows


def plain_flat(n, rows):
    """Labels, probabilities and outlier scores of the most stable clusters, the root left out."""
    birth = {n: 0.0} | {c: lam for _, c, lam, k in rows if c >= n}
    kids = {c: [b for a, b, _, _ in rows if a == c and b > n] for c in birth}
    stability = {c: sum((lam - birth[c]) * k for a, _, lam, k in rows if a == c) for c in birth}

    def best(c):
        inner = [best(k) for k in kids[c]]
        total = sum(v for v, _ in inner)
        if c == n or total > stability[c]:
            return total, [x for _, found in inner for x in found]
        return stability[c], [c]

    chosen = sorted(best(n)[1])
    up = {c: p for p, c, _, _ in rows}

    def over(c):
        while c not in chosen and c != n:
            c = up[c]
        return c if c in chosen else None

    def below(c):
        return [c] + [x for k in kids[c] for x in below(k)]

    peak = {c: max((lam for a, _, lam, _ in rows if a in set(below(c))), default=0.0) for c in birth}
    labels, probabilities, scores = [-1] * n, [0.0] * n, [0.0] * n
    for parent, p, lam, _ in rows:
        if p < n:
            top = over(parent)
            if top is not None:
                labels[p], probabilities[p] = chosen.index(top), min(lam, peak[top]) / peak[top]
            scores[p] = (peak[parent] - lam) / peak[parent]
    return labels, probabilities, scores


def collected(model):
    rows = model.points.orderBy("id").collect()
    return [r["label"] for r in rows], [r["probability"] for r in rows], [r["outlier_score"] for r in rows]


@pytest.mark.parametrize("name", KNOWN)
def test_known_distances(spark, name):
    metric = M.metric_of(name)
    assert metric.kernel(A, B)[0, 0] == pytest.approx(KNOWN[name])
    df = spark.createDataFrame([(A[0].tolist(), B[0].tolist())], "a array<double>, b array<double>")
    assert df.select(metric.distance(df.a, df.b)).first()[0] == pytest.approx(KNOWN[name])


def test_extreme_and_minkowski(spark):
    big = np.array([[1e200, 0.0]])
    assert M.EUCLIDEAN.kernel(big, np.zeros((1, 2)))[0, 0] == pytest.approx(1e200)
    small = np.array([[3e-200, 4e-200]])
    assert M.EUCLIDEAN.kernel(small, np.zeros((1, 2)))[0, 0] == pytest.approx(5e-200)
    df = spark.createDataFrame([([1e200, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(M.EUCLIDEAN.distance(df.a, df.b)).first()[0] == pytest.approx(1e200)
    assert M.minkowski(3).kernel(A, B)[0, 0] == pytest.approx(sum(g**3 for g in GAPS) ** (1 / 3))
    with pytest.raises(errors.InvalidConfig):
        M.minkowski(0.5)
    with pytest.raises(Exception, match="length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(M.MANHATTAN.distance(M.F.col("a"), M.F.col("b"))).collect()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.floats(-1e3, 1e3), min_size=3, max_size=3), min_size=2, max_size=6), st.sampled_from(sorted(KNOWN)))
def test_metrics_are_symmetric(rows, name):
    x = np.array(rows)
    d = M.metric_of(name).kernel(x, x)
    assert np.allclose(d, d.T) and np.allclose(np.diag(d), 0) and (d >= 0).all()


@pytest.mark.parametrize("alpha", [1.0, 1.5])
def test_fit_is_the_plain_fit(spark, alpha):
    x = np.round(blobs(1), 1)  # rounding makes ties
    edges, merges, condensed = plain_fit(x, 4, 3, alpha)
    model = fit(frame(spark, x), Config(min_cluster_size=4, min_samples=3, alpha=alpha))
    assert [(r["src"], r["dst"]) for r in model.mst.orderBy("seq").collect()] == [(i, j) for i, j, _ in edges]
    assert [(r["left"], r["right"], r["size"]) for r in model.linkage.orderBy("seq").collect()] == [(m[0], m[1], m[3]) for m in merges]
    got = sorted((r["parent"], r["child"], r["child_size"], r["lambda_val"]) for r in model.condensed.collect())
    want = sorted((p, c, k, lam) for p, c, lam, k in condensed)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    labels, probabilities, scores = plain_flat(len(x), condensed)
    mine = collected(model)
    assert mine[0] == labels and np.allclose(mine[1], probabilities) and np.allclose(mine[2], scores)
    assert model.mst.count() == len(x) - 1 and all(0 <= p <= 1 for p in probabilities)


def test_blocks_and_approximation_agree(spark):
    x = blobs(2, 90, 3)
    df = frame(spark, x)
    one = fit(df, Config(min_cluster_size=5))
    for other in (fit(df, Config(min_cluster_size=5, prim_rows=1, block_rows=20)), fit(df, Config(min_cluster_size=5, algorithm="approximate"))):
        assert evaluation.same_partition(one.labels, other.labels).first()[0]
    assert fit(df, Config(min_cluster_size=5, prim_rows=1, block_rows=20)).mst.agg({"distance": "sum"}).first()[0] == pytest.approx(one.mst.agg({"distance": "sum"}).first()[0])


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev", "minkowski(3)"])
def test_cells_find_the_same_neighbours(spark, monkeypatch, metric):
    rng = np.random.default_rng(17)
    x = np.concatenate([np.round(rng.normal(0, 3, (150, 3)), 0), np.zeros((40, 3)), rng.normal(50, 1, (30, 3))])  # ties, and one place that many share
    df, asked, m = frame(spark, x), frame(spark, rng.normal(0, 10, (50, 3))), M.metric_of(metric)
    shape = vectors.validate(df)
    want = [sorted(map(tuple, neighbors.knn(q, df, 4, m, shape).collect())) for q in (df, asked)]
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", 0)
    assert [sorted(map(tuple, neighbors.knn(q, df, 4, m, shape, block_rows=8).collect())) for q in (df, asked)] == want
    left, right = cells.pairs(df, df, 5, m, shape, 8)
    assert left.count() < 0.8 * right.count() ** 2  # far cells don't meet


def test_rows_meet_few_cells_beyond_their_own(spark):
    x = np.random.default_rng(5).random((20_000, 2))
    df, shape = frame(spark, x).repartition(4).persist(), vectors.Shape(20_000, 2)
    left, _ = cells.pairs(df, df, 6, M.EUCLIDEAN, shape, 512)
    assert left.select(F.sum(F.length("ids") / 8)).first()[0] < 2 * len(x)
    df.unpersist()


def test_manifests():
    text = '{"schema_version": 1, "recipes": [{"name": "a", "generator": "duplicate_grid", "seed": 1, "rows": 9, "dimensions": 2, "duplicate_fraction": 0.5}]}'
    assert manifest(text)[0].rows == 9
    for wrong in (text.replace("1,", "2,", 1), text.replace('"rows"', '"other"'), text.replace("]}", ', {"name": "a", "generator": "duplicate_grid", "seed": 1, "rows": 9, "dimensions": 2, "duplicate_fraction": 0.5}]}'), '{"x": 1}'):
        with pytest.raises(errors.InvalidConfig):
            manifest(wrong)


def test_rounds_and_ranges_change_nothing(spark, monkeypatch):
    x = blobs(16, 120)
    df = frame(spark, x)
    whole = sorted(map(tuple, fit(df, Config(min_cluster_size=5)).mst.select("distance").collect()))
    monkeypatch.setattr(spanning, "MERGED", 2)
    rounds = fit(df, Config(min_cluster_size=5, prim_rows=1, block_rows=15)).mst
    assert np.allclose(sorted(map(tuple, rounds.select("distance").collect())), whole) and rounds.count() == len(x) - 1
    values = df.select("id", F.round(F.get("features", F.lit(0)), 0).alias("value"))  # ties go by id
    one = sorted(map(tuple, approximate.places(values, len(x)).collect()))
    monkeypatch.setattr(approximate, "ONE_TASK_ROWS", 10)
    assert sorted(map(tuple, approximate.places(values, len(x)).collect())) == one


def test_relational_analytics_are_the_kernels(spark):
    model = fit(frame(spark, blobs(3)), Config(min_cluster_size=4, min_samples=3))
    t, n = model.tree, model.size
    condensed = model.condensed
    stability = {r["cluster"]: r["stability"] for r in analytics.stabilities(condensed, n).collect()}
    want = tree.stabilities(t)
    assert all(v == pytest.approx(want[c]) for c, v in stability.items())
    selected = model.clusters.selectExpr("cluster_id AS cluster")
    mine = analytics.points(condensed, selected, n).orderBy("id").collect()
    labels, probabilities, scores = collected(model)
    assert [r["label"] for r in mine] == labels and np.allclose([r["probability"] for r in mine], probabilities) and np.allclose([r["outlier_score"] for r in mine], scores)
    persistence = {r["label"]: r["persistence"] for r in model.clusters.collect()}
    assert all(r["persistence"] == pytest.approx(persistence[r["label"]]) for r in analytics.persistences(condensed, selected, n).collect())


def test_duplicates_single_cluster_and_noise(spark):
    twice = np.array([[0, 0]] * 3 + [[0, 1]] * 3 + [[9, 9]] * 4, float)
    model = fit(frame(spark, twice), Config(min_cluster_size=2, min_samples=2))
    assert model.cluster_count() >= 2
    far = np.array([[0, 0], [10, 0], [0, 10], [20, 20]], float)
    assert set(collected(fit(frame(spark, far), Config(min_cluster_size=3, min_samples=3)))[0]) == {-1}
    one = fit(frame(spark, blobs(4)[:20]), Config(min_cluster_size=5, extraction=ExtractionConfig(allow_single_cluster=True)))
    assert one.cluster_count() >= 1


def test_extract_again(spark):
    model = fit(frame(spark, blobs(5)), Config(min_cluster_size=4))
    for config in (ExtractionConfig(method="leaf"), ExtractionConfig(epsilon=0.5), ExtractionConfig(max_cluster_size=10), ExtractionConfig(persistence=1.0)):
        points, clusters = model.extract(config)
        flat = tree.extract(model.tree, config)
        assert [r["label"] for r in points.orderBy("id").collect()] == flat.labels.tolist()
        assert clusters.count() == len(flat.clusters)


def test_clusters_merged_to_one_ancestor_repeat_no_point(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.2, (20, 2)) for c in (0, 2, 4, 40)])
    model = fit(frame(spark, x), Config(min_cluster_size=5))
    points, clusters = model.extract(ExtractionConfig(epsilon=8.0))
    assert clusters.count() < model.cluster_count()  # some were merged
    assert sorted(r["id"] for r in points.collect()) == list(range(len(x)))


def test_errors(spark):
    with pytest.raises(errors.TooFewPoints):
        fit(frame(spark, [[1.0]]))
    for bad in ([[1.0], [float("nan")]], [[1.0], [float("inf")]]):
        with pytest.raises(errors.NonFinite):
            fit(frame(spark, bad))
    with pytest.raises(errors.InvalidShape):
        fit(frame(spark, [[1.0], [1.0, 2.0]]))
    for wrong in ({"min_cluster_size": 1}, {"min_samples": 0}, {"alpha": 0.0}, {"alpha": float("nan")}, {"algorithm": "x"}, {"extraction": ExtractionConfig(method="x")}, {"extraction": ExtractionConfig(persistence=2.0)}, {"metric": "manhattan", "algorithm": "kdtree"}):
        with pytest.raises(errors.InvalidConfig):
            Clusterer(**wrong)
    model = fit(frame(spark, blobs(6)))
    with pytest.raises(errors.PredictionDataMissing):
        model.predict(frame(spark, [[0.0, 0.0]]))
    with pytest.raises(errors.BranchDataMissing):
        model.detect_branches()


def test_graphs(spark):
    edges = graphs.from_csr(spark, [1, 1, 3, 1, 1, 3], [1, 0, 2, 3, 2, 1], [0, 1, 3, 4, 6])
    with pytest.raises(errors.InvalidSparse):
        fit_graph(edges, 4, Config(min_cluster_size=2, min_samples=1))
    line = spark.createDataFrame([(a, b, d) for x, y, d in ((0, 1, 1.0), (1, 2, 3.0), (2, 3, 1.0)) for a, b in ((x, y), (y, x))], "src long, dst long, distance double")
    assert collected(fit_graph(line, 4, Config(min_cluster_size=2, min_samples=1)))[0] == [0, 0, 1, 1]
    with pytest.raises(errors.InsufficientNeighbors):
        fit_graph(line, 4, Config(min_cluster_size=2, min_samples=2))
    with pytest.raises(errors.Disconnected):
        fit_graph(line.where("distance < 2"), 4, Config(min_cluster_size=2, min_samples=1))
    with pytest.raises(errors.PredictionUnsupported):
        fit_graph(line, 4, Config(prediction_data=True))
    x = blobs(7, 30)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    matrix = graphs.from_matrix(frame(spark, d))
    dense = fit_precomputed(matrix, 30, Config(min_cluster_size=4))
    assert evaluation.same_partition(dense.labels, fit(frame(spark, x), Config(min_cluster_size=4)).labels).first()[0]
    with pytest.raises(errors.InvalidPrecomputed):
        fit_precomputed(matrix.where("src <> 3 OR dst <> 4"), 30)


def rows_of(spark, weights):
    """Of a square array, NaN where there is no edge."""
    held = {i: (np.flatnonzero(~np.isnan(w)), w[~np.isnan(w)]) for i, w in enumerate(weights)}

    def read(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield i, *held[i]

    return graphs.Rows(spark.range(len(weights), numPartitions=3), read)


def edges_of(spark, weights):
    src, dst = np.nonzero(~np.isnan(weights))
    return spark.createDataFrame([(int(a), int(b), float(weights[a, b])) for a, b in zip(src, dst, strict=True)], "src long, dst long, distance double")


def trees(fitted):
    return [sorted(map(tuple, d.collect())) for d in (fitted.mst.select("src", "dst", "distance"), fitted.points, fitted.condensed)]


@pytest.mark.parametrize("share, ties", [(0.06, False), (0.06, True), (0.9, True)])
def test_graphs_by_rows_give_the_tree_of_their_edges(spark, monkeypatch, share, ties):
    n, rng = 150, np.random.default_rng(13)
    w = rng.integers(1, 6, (n, n)).astype(float) if ties else rng.random((n, n))
    w[rng.random((n, n)) > share] = np.nan
    w = np.triu(w, 1) + np.tril(np.full((n, n), np.nan))
    w[np.arange(n - 1), np.arange(1, n)] = 9.0  # some edges that join all, and more than one part without them
    w[:60, 60:] = w[60:, :60] = np.nan
    w[59, 60] = 9.0
    w = np.where(np.isnan(w), w.T, w)
    monkeypatch.setattr(adjacency, "SAMPLE", 4)
    config = Config(min_cluster_size=3, min_samples=2, alpha=1.5)
    assert trees(fit_graph_rows(rows_of(spark, w), n, config)) == trees(fit_graph(edges_of(spark, w), n, config))


def test_graphs_by_rows_leave_few_edges_to_the_forests(spark):
    n, rng = 600, np.random.default_rng(3)
    x = rng.random((n, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    found = adjacency.summary(graphs.matrix_rows(frame(spark, d)), n, 3, dense=True)
    bounds = adjacency.Bounds.of(found, 1.0)
    left = sum(len(bounds.within(i, None, d[i], 1.0)[0]) for i in range(n))
    others = np.arange(n)
    assert left == sum(len(bounds.within(i, others[others != i], np.delete(d[i], i), 1.0)[0]) for i in range(n))
    assert n - 1 <= left < 2 * n
    assert np.allclose(found.core, np.sort(d, axis=1)[:, 3])


def test_graphs_by_rows_are_checked(spark):
    w = np.full((4, 4), np.nan)
    for a, b, d in ((0, 1, 1.0), (1, 2, 3.0), (2, 3, 1.0)):
        w[a, b] = w[b, a] = d
    config = Config(min_cluster_size=2, min_samples=1)
    assert collected(fit_graph_rows(rows_of(spark, w), 4, config))[0] == [0, 0, 1, 1]
    with pytest.raises(errors.InsufficientNeighbors):
        fit_graph_rows(rows_of(spark, w), 4, Config(min_cluster_size=2, min_samples=2))
    for a, b, d in ((2, 1, 2.0), (3, 0, 1.0), (0, 1, -1.0), (0, 1, np.inf), (1, 1, 1.0)):
        bad = w.copy()
        bad[a, b] = d
        with pytest.raises(errors.InvalidSparse):
            fit_graph_rows(rows_of(spark, bad), 4, config)
    repeated = graphs.Rows(spark.range(2), lambda batches: ((i, np.array([1 - i, 1 - i]), np.ones(2)) for b in batches for i in b.column(0).to_pylist()))
    with pytest.raises(errors.InvalidSparse):
        fit_graph_rows(repeated, 2, config)
    w[1, 2] = w[2, 1] = np.nan
    with pytest.raises(errors.Disconnected):
        fit_graph_rows(rows_of(spark, w), 4, config)


def test_groups_by_rows_are_those_of_their_pairs(spark):
    members = spark.createDataFrame([(0, 5.0, 1), (1, 200.0, 1), (3, 7.5, 1), (4, 1.0, 2)], "id long, value double, group long")
    rows = graphs.group_rows(members, 5, 50.0)
    import pyarrow as pa

    got = {(i, int(j)): float(v) for i, others, d in rows.read([pa.RecordBatch.from_pydict({"id": list(range(5))})]) for j, v in zip(others, d, strict=True)}
    half = {(0, 1): 50.0, (0, 3): 2.5, (1, 3): 192.5, (1, 2): 50.0, (2, 3): 50.0, (3, 4): 50.0}
    assert got == half | {(b, a): v for (a, b), v in half.items()}


@pytest.mark.parametrize("held", [1 << 29, 0])
def test_matrices_by_rows(spark, monkeypatch, held):
    monkeypatch.setattr(models, "MATRIX_BYTES", held)
    x = blobs(7, 30)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    n, config = len(d), Config(min_cluster_size=4, alpha=1.25)
    want = fit_precomputed(graphs.from_matrix(frame(spark, d)), n, config)
    for rows in (graphs.matrix_rows(frame(spark, d)), graphs.distance_rows(frame(spark, x), 0, x.shape[1], M.EUCLIDEAN)):
        got = fit_matrix(rows, n, config)
        assert np.allclose([r["distance"] for r in got.mst.orderBy("seq").collect()], [r["distance"] for r in want.mst.orderBy("seq").collect()], atol=1e-12)
        assert collected(got)[0] == collected(want)[0]
    apart = d.copy()
    apart[:5, 5:] = apart[5:, :5] = np.inf
    with pytest.raises(errors.Disconnected):
        fit_matrix(graphs.matrix_rows(frame(spark, apart)), n, config)
    for a, b, v in ((3, 4, 0.5), (2, 2, 1.0), (1, 2, -1.0), (1, 2, np.nan)):
        bad = d.copy()
        bad[a, b] = v
        with pytest.raises(errors.InvalidPrecomputed):
            fit_matrix(graphs.matrix_rows(frame(spark, bad)), n, config)
    with pytest.raises(errors.InvalidPrecomputed):
        fit_matrix(graphs.matrix_rows(frame(spark, d).where("id <> 3")), n, config)


def test_robust(spark):
    line = frame(spark, [[0.0], [0.3], [0.5], [4.0], [4.2], [9.0]])
    got = robust_single_linkage(line, RobustConfig(cut=1.0, k=1, gamma=2))
    assert [r["label"] for r in got.labels.orderBy("id").collect()] == [0, 0, 0, 1, 1, -1]
    assert [r["label"] for r in cut_linkage(got.linkage, line.select("id"), 1.0, 3).orderBy("id").collect()] == [0, 0, 0, -1, -1, -1]
    assert {r["label"] for r in cut_linkage(got.linkage, line.select("id"), 0.1, 2).collect()} == {-1}
    with pytest.raises(errors.InvalidConfig):
        cut_linkage(got.linkage, line.select("id"), float("nan"), 2)


def test_validity(spark):
    # Core densities of 0, 1, 2, 3: 18/11, 6/5, 6/5, 18/11. The inner edge weighs 6/5; the inner vertices 2 and 11 are 9 apart.
    rows = frame(spark, [[v] for v in (0.0, 1.0, 2.0, 3.0, 10.0, 11.0, 12.0, 13.0, 40.0, 90.0)])
    score, per = validity(rows, labelled(spark, [0] * 4 + [1] * 4 + [-1, -1]))
    each = (9 - 6 / 5) / 9
    assert per == pytest.approx([each, each]) and score == pytest.approx(0.8 * each)
    # No edge joins two inner vertices of three points.
    assert validity(frame(spark, [[v] for v in (0.0, 1.0, 3.0, 20.0, 21.0, 23.0)]), labelled(spark, [1, 1, 1, 0, 0, 0])) == (1.0, [1.0, 1.0])
    # Pairs have no inner vertex; two points in two dimensions: the first ones are 30 apart, each pair 2.
    score, per = validity(frame(spark, [[0.0, 0.0], [2.0, 0.0], [30.0, 0.0], [32.0, 0.0]]), labelled(spark, [0, 0, 1, 1]))
    assert per == pytest.approx([28 / 30] * 2) and score == pytest.approx(28 / 30)
    assert validity(rows, labelled(spark, [-1] * 10)) == (0.0, [])
    with pytest.raises(errors.InvalidConfig):
        validity(rows, labelled(spark, [0] * 9 + [1]))


@pytest.mark.parametrize("what", ["predict", "predict_scores", "membership"])
def test_prediction_by_join_is_that_with_vectors_sent(spark, monkeypatch, what):
    x, q = np.round(blobs(13), 1), np.round(blobs(14) * 1.2, 1)  # rounding makes ties
    model = fit(frame(spark, x), Config(min_cluster_size=5, min_samples=4, prediction_data=True, block_rows=16))
    sent = sorted(map(tuple, getattr(model, what)(frame(spark, q)).collect()))
    monkeypatch.setattr(prediction, "SENT_BYTES", 0)
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", 0)
    model.cache.clear()
    joined = sorted(map(tuple, getattr(model, what)(frame(spark, q)).collect()))
    assert model.predictor().lookup.x is None and len(sent) >= len(q)
    assert [r[:-1] for r in sent] == [r[:-1] for r in joined] and np.allclose([r[-1] for r in sent], [r[-1] for r in joined])


def test_distances_that_are_none(spark):
    x = frame(spark, blobs(15, 12))
    for wrong in (float("nan"), float("inf"), -1.0):
        with pytest.raises(errors.InvalidDistance):
            fit(x, Config(min_cluster_size=2, metric=lambda a, b, wrong=wrong: wrong))
    labels = fit_predict(x, Config(min_cluster_size=2, metric=lambda a, b: float(np.abs(a - b).sum())))
    assert evaluation.same_partition(labels, fit_predict(x, Config(min_cluster_size=2, metric="manhattan"))).first()[0]


class Wrong:
    """A backend with one thing wrong."""

    def __init__(self, core=None, edge=None, rows=6):
        self.core, self.edge, self.rows = core, edge, rows

    def build(self, df, metric, k, alpha, shape):
        spark = df.sparkSession
        core = [(i, 1.0) for i in range(self.rows)]
        edges = [(i, i + 1, 1.0 + i) for i in range(5)]
        if self.core is not None:
            core[2] = self.core
        if self.edge is not None:
            edges[2] = self.edge
        return spark.createDataFrame(core, "id long, core double"), spark.createDataFrame(edges, "src long, dst long, distance double")


@pytest.mark.parametrize(
    ("wrong", "kind"),
    [({"core": (2, float("nan"))}, errors.InvalidShape), ({"core": (9, 1.0)}, errors.InvalidShape), ({"core": (2, -1.0)}, errors.InvalidShape), ({"rows": 5}, errors.InvalidShape), ({"edge": (2, 11, 1.0)}, errors.InvalidShape), ({"edge": (2, 3, float("inf"))}, errors.Disconnected), ({"edge": (0, 1, 3.0)}, errors.Disconnected)],
)
def test_backends_are_checked(spark, wrong, kind):
    x = frame(spark, [[float(i * i)] for i in range(6)])
    assert fit(x, Config(min_cluster_size=2, algorithm="approximate", approximate_backend=Wrong())).mst.count() == 5
    with pytest.raises(kind):
        fit(x, Config(min_cluster_size=2, algorithm="approximate", approximate_backend=Wrong(**wrong)))


def test_cancellation_ends_the_running_action(spark):
    outcome, started = [], threading.Event()

    def work():
        try:
            with jobs.cancellable(spark, "long-work"):
                started.set()
                spark.range(4, numPartitions=4).select(F.udf(lambda i: time.sleep(60) or i, "long")("id")).collect()
            outcome.append("ended")
        except Exception as error:  # noqa: BLE001
            outcome.append(str(error))

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    started.wait(10)
    tracker, until = spark.sparkContext.statusTracker(), time.time() + 30
    while not tracker.getActiveJobsIds() and time.time() < until:
        time.sleep(0.1)
    jobs.cancel(spark, "long-work")
    thread.join(30)
    assert not thread.is_alive() and "cancel" in outcome[0].lower()
    assert spark.range(3).count() == 3  # the session goes on


def test_prediction_and_stream(spark, tmp_path):
    x = blobs(8)
    model = fit(frame(spark, x), Config(min_cluster_size=5, prediction_data=True, branch_data=True))
    labels = collected(model)[0]
    again = model.predict(frame(spark, x)).orderBy("id").collect()
    assert sum(a["label"] == b for a, b in zip(again, labels, strict=True)) >= 50
    everywhere = model.all_points_membership().groupBy("id").sum("membership").collect()
    assert len(everywhere) == len(x) and all(-1e-9 <= r[1] <= 1 + 1e-9 for r in everywhere)
    assert model.membership(frame(spark, [[0.0, 0.0]])).count() == model.cluster_count()
    far = model.predict_scores(frame(spark, [[100.0, 100.0]])).first()["outlier_score"]
    assert 0.9 < far <= 1
    with pytest.raises(errors.InvalidShape):
        model.predict(frame(spark, [[1.0]]))
    frame(spark, x).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, features array<double>").parquet(str(tmp_path / "in"))
    for f, name in ((predict_stream, "s1"), (score_stream, "s2")):
        q = f(model, stream).writeStream.format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert [r["label"] for r in spark.sql("SELECT * FROM s1 ORDER BY id").collect()] == [r["label"] for r in again]
    assert spark.table("s2").count() == len(x)


def test_branches(spark, tmp_path):
    bar, stem = [(0.5 * i, 0.0) for i in range(-14, 15)], [(0.0, -0.5 * i) for i in range(1, 17)]  # a letter T
    n = len(bar) + len(stem)
    model = fit(frame(spark, bar + stem), Config(min_cluster_size=3, min_samples=3, prediction_data=True, branch_data=True))
    found = model.detect_branches(BranchConfig(min_cluster_size=3), labelled(spark, [0] * n))
    points = found.points.orderBy("id").collect()
    assert found.persistences.count() >= 3 and len(points) == n and all(0 <= p["probability"] <= 1 for p in points)
    found.export(str(tmp_path / "branches"))
    assert spark.read.option("header", True).csv(str(tmp_path / "branches")).columns == ["from", "to", "centrality", "reachability"]
    edge = found.graph.first()
    assert (edge["packed"] >> 32, edge["packed"] & 0xFFFFFFFF) == (edge["src"], edge["dst"])
    assert found.predict(frame(spark, bar[:3])).count() == 3
    with pytest.raises(errors.InvalidConfig):
        model.detect_branches(labels=labelled(spark, [0] * (n - 1) + [2]))


def test_evaluation_sources_exports(spark, tmp_path):
    a, b = labelled(spark, [0, 0, 1, 1, -1]), labelled(spark, [5, 5, 2, 2, 9])
    assert evaluation.adjusted_rand_index(a, b).first()[0] == pytest.approx(1.0)
    assert [r["label"] for r in evaluation.canonical_labels(labelled(spark, [7, -1, 3, 7])).orderBy("id").collect()] == [0, -1, 1, 0]
    assert SplitMix(0).word() == 0xE220A8397B1DCDAF
    for recipe in (Recipe("b", "gaussian_blobs", 1, 40, 2, clusters=3, spread=0.2), Recipe("n", "noise_mixture", 1, 40, 2, clusters=2, spread=0.2, noise_fraction=0.5), Recipe("g", "duplicate_grid", 1, 40, 2, duplicate_fraction=0.5)):
        assert vectors.validate(generate(spark, recipe)) == vectors.Shape(40, 2)
    with pytest.raises(errors.InvalidConfig):
        generate(spark, Recipe("x", "other", 1, 1, 1))
    model = fit(frame(spark, blobs(9)))
    model.export("condensed", str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["parent", "child", "lambda", "child_size"]
    model.export("mst", str(tmp_path / "m"), exports.JSON)
    assert spark.read.json(str(tmp_path / "m")).count() == 59
    assert select_algorithm(frame(spark, blobs(9))) == "kdtree" and select_algorithm(frame(spark, blobs(9)), "manhattan") == "bruteforce"


@pytest.mark.parametrize("digits", [7, 8])
def test_quick_rounding_is_that_of_decimals(spark, digits):
    rng = np.random.default_rng(12)
    unit = 10.0**-digits
    ties = (rng.integers(0, 10**6, 2000) + 0.5) * unit
    x = np.concatenate([rng.random(5000), rng.random(2000) * 1e-6, ties, np.nextafter(ties, 0), np.nextafter(ties, 1), rng.normal(0, 1e5, 2000), rng.integers(0, 10**8, 500) * unit, [0.0, -0.0, 5e-324, 39.9999999999, 40.0, 1e15, 1e300, np.inf, np.nan]])
    df = spark.createDataFrame([(float(v),) for v in np.concatenate([x, -x])] + [(None,)], "x double")
    pairs = df.select(F.round("x", digits).alias("want"), queries.rounded("x", digits).alias("got")).collect()
    assert len(pairs) == 2 * len(x) + 1 and all(str(r["want"]) == str(r["got"]) for r in pairs)


def test_cut_components_of_long_paths(spark):
    """Rounds and plans stay small where components are long paths in no order of ids."""
    n = 3000
    order = np.random.default_rng(5).permutation(n)
    rows = [(int(a), int(b), 1.0 if i % 1000 != 499 else 9.0) for i, (a, b) in enumerate(zip(order, order[1:], strict=False))]
    edges = spark.createDataFrame(rows, "src long, dst long, distance double")
    began = time.time()
    got = dict(analytics.cut_components(edges, spark.range(n), 5.0, 501).collect())
    assert time.time() - began < 60
    parts = [order[:500], order[500:1500], order[1500:2500], order[2500:]]
    large = sorted((p for p in parts if len(p) > 500), key=min)
    want = {int(i): -1 for i in range(n)} | {int(i): k for k, p in enumerate(large) for i in p}
    assert got == want


@pytest.mark.parametrize("metric", [M.EUCLIDEAN, M.CANBERRA])
@pytest.mark.parametrize("alpha", [1.0, 2.0])
def test_block_trees_are_the_tree_of_all_pairs(spark, metric, alpha):
    """Under (reach, smaller id, larger id), on points of a grid with many copies, whose distances tie."""
    rng = np.random.default_rng(3)
    x, core = rng.integers(1, 12, (400, 2)).astype(float), rng.integers(0, 2, 400).astype(float)
    ids = rng.permutation(1000)[:400]
    points = spark.createDataFrame([(int(i), [float(v) for v in row], float(c)) for i, row, c in zip(ids, x, core, strict=True)], "id long, features array<double>, core double")
    got = sorted(map(tuple, spanning.block_candidates(points, metric, alpha, 2, 400, block_rows=32).collect()))
    order = np.argsort(ids)
    ids, x, core = ids[order], x[order], core[order]
    w = np.maximum(metric.kernel(x, x) / alpha, np.maximum(core[:, None], core))
    a, b = np.triu_indices(400, 1)
    want = tree.kruskal(400, a, b, w[a, b])
    assert got == sorted(zip(ids[want.src].tolist(), ids[want.dst].tolist(), want.distance.tolist(), strict=True))


@pytest.mark.parametrize("metric", [M.EUCLIDEAN, M.SQUARED_EUCLIDEAN])
@pytest.mark.parametrize("alpha", [1.0, 2.0])
@pytest.mark.parametrize("tied", [False, True])
def test_wide_trees_are_the_tree_of_all_pairs(spark, monkeypatch, metric, alpha, tied):
    """Under (reach, smaller id, larger id), in blocks, with parts that the neighbours' edges leave, and with copies."""
    rng = np.random.default_rng(8)
    n = 300
    x = np.concatenate([rng.normal(c, 1, (n // 6, 40)) for c in (0, 3, 3, 9, 1000, 1000)])
    if tied:
        x = np.concatenate([np.round(x[: n // 2] / 4), np.round(x[: n // 2] / 4)])
    ids = rng.permutation(1000)[:n]
    points = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "id long, features array<double>")
    shape = vectors.Shape(n, 40)
    monkeypatch.setattr(spanning, "SIDE", 32)
    monkeypatch.setattr(spanning, "FOLDED", 100)
    monkeypatch.setattr(spanning, "MIDDLES", 2)
    near = neighbors.knn(points, points, 2, metric, shape).persist()
    core = near.where("rank = 2").select("id", F.col("distance").alias("core"))
    got = sorted(map(tuple, spanning.ordered_candidates(points.join(core, "id"), near, metric, alpha, shape, 2, block_rows=90).collect()))
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    d = metric.kernel(x, x)
    core = np.sort(d, axis=1)[:, 2]
    w = np.maximum(d / alpha, np.maximum(core[:, None], core))
    a, b = np.triu_indices(n, 1)
    want = tree.kruskal(n, a, b, w[a, b])
    assert got == sorted(zip(ids[want.src].tolist(), ids[want.dst].tolist(), want.distance.tolist(), strict=True))


@pytest.mark.parametrize("case", ["normal", "tied", "offset", "tiny", "huge"])
def test_products_find_the_same_neighbours_and_fold_few(monkeypatch, case):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (600, 24))
    x = {"normal": x, "tied": np.round(x[:, :2] @ np.ones((2, 24))), "offset": x * 1e-6 + 1e3, "tiny": x * 1e-160, "huge": x * 1e160}[case]
    ids, folded, plain = rng.permutation(600), [], neighbors.paired
    monkeypatch.setattr(neighbors, "paired", lambda metric, a, b: folded.append(len(a)) or plain(metric, a, b))
    for keep in (False, True):
        got = neighbors.nearest(ids[:50], x[:50], ids, x, 4, M.EUCLIDEAN, keep)
        d = M.EUCLIDEAN.kernel(x[:50], x)
        if not keep:
            d[ids[:50, None] == ids] = np.inf
        order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :4]
        assert (got[1].reshape(50, 4) == ids[order]).all() and (got[2].reshape(50, 4) == np.take_along_axis(d, order, 1)).all()
    if case == "normal":
        assert 0 < max(folded) < 50 * 60


def test_fits_of_wide_vectors_fold_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(0, 1, (400, 48)) + 4 * rng.integers(0, 4, 400)[:, None]
    x[-60:] = x[:60]
    one, two = (fit(frame(spark, x), Config(min_cluster_size=5, prim_rows=rows)) for rows in (1000, 1))
    assert evaluation.same_partition(one.labels, two.labels).first()[0]
    assert two.mst.agg({"distance": "sum"}).first()[0] == pytest.approx(one.mst.agg({"distance": "sum"}).first()[0])
    d = M.EUCLIDEAN.kernel(x, x)
    pairs = spanning.survivors(x, x, np.zeros(400), np.zeros(400), np.full((400, 400), np.sort(d, axis=1)[:, 5].max()), M.EUCLIDEAN, 1.0)
    assert pairs is None or len(pairs[0]) < 400 * 400 // 16


def test_reachability_of_all_pairs_comes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "PAIRED_ROWS", 16)
    x = np.round(blobs(31), 1)
    df, core = frame(spark, x), spark.createDataFrame([(i, i / 40) for i in range(len(x))], "id long, core double")
    found = neighbors.mutual_reachability(df, core, M.EUCLIDEAN, alpha=2.0)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]  # rows aren't paired one by one
    d = M.EUCLIDEAN.kernel(x, x)
    want = [(a, b, d[a, b], max(d[a, b] / 2, a / 40, b / 40)) for a in range(len(x)) for b in range(a + 1, len(x))]
    assert sorted(map(tuple, found.collect())) == want
    ragged = df.union(spark.createDataFrame([(99, [1.0])], df.schema))
    with pytest.raises(Exception, match="differ in length"):
        neighbors.mutual_reachability(ragged, core.union(spark.createDataFrame([(99, 0.0)], core.schema)), M.EUCLIDEAN).collect()


def test_reachability_of_all_pairs_writes_no_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "PAIRED_ROWS", 8)
    x = np.repeat(np.round(blobs(31)[:20], 1), 6, axis=0)
    ids = np.random.default_rng(3).permutation(len(x))
    df = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist(), strict=True)], "id long, features array<double>")
    core = spark.createDataFrame([(int(i), float(v[0] > 0)) for i, v in zip(ids, x, strict=True)], "id long, core double")
    at = np.argsort(ids)
    d, c = M.EUCLIDEAN.kernel(x[at], x[at]), (x[at, 0] > 0).astype(float)
    want = [(a, b, d[a, b], max(d[a, b] / 2, c[a], c[b])) for a in range(len(x)) for b in range(a + 1, len(x))]
    for most in (neighbors.BROADCAST_BYTES, 0):  # blocks sent to all tasks, and met partition by partition
        monkeypatch.setattr(neighbors, "BROADCAST_BYTES", most)
        found = neighbors.mutual_reachability(df, core, M.EUCLIDEAN, alpha=2.0)
        plan = found._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("Product" if "Product" in plan else "NestedLoop")] if "Join" in plan or "Product" in plan else plan
        assert "Exchange" not in above  # no shuffle of what grows with the square of the rows
        assert sorted(map(tuple, found.collect())) == want


@pytest.mark.parametrize("rows", [1, 2, 8, 9, 16, 17, 24, 33])
def test_reachability_meets_each_pair_of_blocks_once(spark, monkeypatch, rows):
    monkeypatch.setattr(neighbors, "PAIRED_ROWS", 2)
    df, core = frame(spark, [[float(i)] for i in range(rows)]), spark.createDataFrame([(i, 0.0) for i in range(rows)], "id long, core double")
    found = neighbors.mutual_reachability(df.coalesce(1), core, M.MANHATTAN).collect()
    assert sorted(tuple(r)[:3] for r in found) == [(a, b, float(b - a)) for a in range(rows) for b in range(a + 1, rows)]


def test_pairs_of_equal_vectors_stand_together():
    rng = np.random.default_rng(5)
    x = np.repeat(np.sort(rng.random((8, 1)), axis=0), 16, axis=0)
    one, two = ((1, rng.permutation(1000)[:128].astype(np.int64).tobytes(), (x + gap).tobytes(), np.zeros(128).tobytes()) for gap in (0.0, 3.0))
    d = np.concatenate([b.column(2).to_numpy() for b in neighbors._reached(one, two, M.EUCLIDEAN, 1.0)])
    assert len(d) > 64 * 16 and np.count_nonzero(np.diff(d)) < 64  # a run for each two vectors


def test_blocks_meet_few_others_where_space_tells(spark):
    x = np.random.default_rng(4).random((20_000, 2))
    points = spark.createDataFrame([(i, [float(a), float(b)], 0.0) for i, (a, b) in enumerate(x)], "id long, features array<double>, core double")
    outlines = spanning._outlines(spanning._blocks(points, M.EUCLIDEAN, 1.0, vectors.Shape(20_000, 2), 128), M.EUCLIDEAN, 1.0, 2)
    blocks = len(outlines["block"])
    assert blocks >= 128
    assert sum(len(spanning.met_blocks(outlines, at, M.EUCLIDEAN, 1.0, True)[0]) for at in range(blocks)) < 8 * blocks


def test_predictions_by_cells_are_those_by_sent_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in (0, 3, 6)])
    df = frame(spark, x)
    asked = frame(spark, x + 0.05)
    asked = asked.union(asked.select((F.col("id") * 0).alias("id"), "features"))  # ids may repeat

    def found():
        model = fit(df, Config(min_cluster_size=5, prediction_data=True, block_rows=16))
        return [sorted(map(tuple, f(asked).collect())) for f in (model.predict, model.predict_scores, model.membership)]

    sent = found()
    monkeypatch.setattr(cells, "LEAST_ROWS", 20)
    assert found() == sent


def test_branches_and_predictions_share_the_search_of_the_fit(spark, monkeypatch):
    rng = np.random.default_rng(21)
    t = np.concatenate([rng.random((60, 1)) * [4, 0], rng.random((60, 1)) * [0, 4], rng.random((60, 1)) * [-4, 0], rng.normal(30, 0.3, (40, 2))])
    x = np.concatenate([t + rng.normal(0, 0.05, t.shape), np.zeros((9, 2))])  # more copies than neighbours are asked for
    df, asked, calls, plain = frame(spark, x), frame(spark, x + 0.02), [], neighbors.knn

    def found():
        calls.clear()
        model = fit(df, Config(min_cluster_size=5, min_samples=4, prediction_data=True, branch_data=True, block_rows=16))
        branches = model.detect_branches(BranchConfig(graph="core", min_cluster_size=5))
        rows = [sorted(map(tuple, d.collect())) for d in (branches.points, branches.predict(asked), branches.graph.select("src", "dst", "centrality", "reachability"))]
        return rows, len(calls)

    monkeypatch.setattr(neighbors, "knn", lambda *a, **b: calls.append(1) or plain(*a, **b))
    sent, _ = found()
    monkeypatch.setattr(cells, "LEAST_ROWS", 20)
    joined, searches = found()
    assert joined == sent and searches == 2  # of the fit and of the asked


def test_memberships_of_equal_points_are_worked_out_once(spark, monkeypatch):
    x = np.repeat(np.round(blobs(15), 2), 3, axis=0)
    model = fit(frame(spark, x), Config(min_cluster_size=8, min_samples=4, prediction_data=True))
    look, seen = model.predictor().lookup, []
    monkeypatch.setattr(look, "spread", lambda closeness, *rest: seen.append(len(closeness)) or prediction.Lookup.spread(look, closeness, *rest))
    monkeypatch.setattr(prediction, "_VALUES", 7 * max(len(look.clusters), len(look.exemplars)))
    found = list(prediction._memberships(look, look.ids, look.x, look.point_cluster, look.point_density, True))
    assert sum(seen) <= len(x) // 2 and max(seen) <= 7 and max(b.num_rows for b in found) <= 7 * len(look.clusters)
    got = sorted(tuple(r.values()) for b in found for r in b.to_pylist())
    want = prediction.Lookup.spread(look, look.closeness(look.x), look.point_cluster, look.point_density, True)
    assert [r[:2] for r in got] == [(i, k) for i in range(len(x)) for k in range(len(look.clusters))]
    assert np.allclose([r[2] for r in got], want.ravel())
    assert sorted(map(tuple, model.all_points_membership().collect())) == got


def test_memberships_of_equal_points_leave_the_task_once(spark):
    x = np.repeat(np.round(blobs(15), 2), 3, axis=0)
    model = fit(frame(spark, x), Config(min_cluster_size=8, min_samples=4, prediction_data=True))
    look = model.predictor().lookup
    kinds = len(np.unique(np.column_stack([look.x, look.point_cluster, look.point_density]), axis=0))
    packed = list(prediction._packed(look, look.ids, look.x, look.point_cluster, look.point_density, True))
    assert sum(b.num_rows for b in packed) == kinds <= len(x) // 2
    got = sorted((i, k, v) for b in packed for r in b.to_pylist() for i in r["ids"] for k, v in enumerate(r["memberships"]))
    assert len(got) == len(x) * len(look.clusters) and sorted(map(tuple, model.all_points_membership().collect())) == got
    asked = model.membership(frame(spark, x))
    assert asked.columns == ["id", "label", "membership"] and asked.count() == len(got)
    rows = model.all_points_membership_vectors().collect()
    assert len(rows) == len(x) and sorted((r["id"], k, v) for r in rows for k, v in enumerate(r["memberships"])) == got


def test_points_without_clusters_have_empty_memberships(spark):
    line = frame(spark, [[0.0], [0.3], [0.5], [4.0]])
    model = fit(line, Config(min_cluster_size=4, prediction_data=True))
    assert model.cluster_count() == 0 and model.all_points_membership().count() == 0
    for rows in (model.all_points_membership_vectors(), model.membership_vectors(line)):
        assert sorted(map(tuple, rows.collect())) == [(i, []) for i in range(4)]


@pytest.mark.parametrize("name, method", [("membership_vectors", "membership"), ("all_points_membership", "all_points_membership")])
def test_membership_queries_give_a_row_for_each_point(spark, name, method):
    from dendra import queries

    folder = "/root/testdata/sf0.001"
    model, asked = queries._predicting(spark, folder), [queries._asked(spark, folder)] if method == "membership" else []
    rows = queries.queries()[name](spark, folder).collect()
    want = sorted(map(tuple, getattr(model, method)(*asked).collect()))
    assert len(rows) == model.size and sorted((r["id"], k, v) for r in rows for k, v in enumerate(r["memberships"])) == want


def test_heights_where_paths_meet(spark):
    """Against climbing from both ends, on a tree of splits."""
    rng = np.random.default_rng(7)
    up, birth, leaves = [-1], [0.0], [0]
    for _ in range(60):
        p = leaves.pop(int(rng.integers(len(leaves))))
        density = birth[p] + rng.random() + 0.01
        leaves += [len(up), len(up) + 1]
        up += [p, p]
        birth += [density, density]
    up, birth = np.array(up), np.array(birth)
    order = np.argsort(birth, kind="stable")  # children have larger ids than their parents
    assert (order[0] == 0) and (up[1:] < np.arange(1, len(up))).all()
    chosen = [c for c in range(len(up)) if c % 3 == 0 and c and not any(a % 3 == 0 and a for a in ancestors_of(up, c))]
    label_of = np.full(len(up), -1)
    label_of[chosen] = np.arange(len(chosen))
    look = prediction.Lookup(*[None] * 5, 0, np.array(chosen), label_of, None, None, None, up, birth, None, None, None, None, *prediction.walk(up, 0, chosen))
    points = np.arange(len(up))
    got = look.heights(points, points + 1000.0)
    for a in points.tolist():
        for k, c in enumerate(chosen):
            mine, other = [a, *ancestors_of(up, a)], [c, *ancestors_of(up, c)]
            meet = next(i for i in mine if i in other)
            assert got[a, k] == (a + 1000.0 if meet in (a, c) else birth[mine[mine.index(meet) - 1]])


def ancestors_of(up, c):
    out = []
    while up[c] >= 0:
        c = int(up[c])
        out.append(c)
    return out
