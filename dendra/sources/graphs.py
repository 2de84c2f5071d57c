"""Distance graphs as edge rows: (src BIGINT, dst BIGINT, distance DOUBLE) and a count of vertices; large ones by rows of a vertex each."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidPrecomputed, InvalidSparse
from ..functions.metrics import Metric


def from_csr(spark: SparkSession, data: Sequence[float], indices: Sequence[int], indptr: Sequence[int]) -> DataFrame:
    """Edges of a compressed sparse row matrix; absent entries are absent edges."""
    if not indptr or indptr[0] != 0 or indptr[-1] != len(data) or len(data) != len(indices) or any(b < a for a, b in zip(indptr, indptr[1:], strict=False)):
        raise InvalidSparse("row pointers don't fit the data")
    rows = [(i, int(indices[k]), float(data[k])) for i in range(len(indptr) - 1) for k in range(indptr[i], indptr[i + 1])]
    return spark.createDataFrame(rows, "src long, dst long, distance double")


def from_matrix(rows: DataFrame) -> DataFrame:
    """(id, features) with a row of a square matrix each, into edges; infinite entries are kept."""
    return rows.select(F.col("id").alias("src"), F.posexplode("features").alias("dst", "distance")).select("src", F.col("dst").cast("long").alias("dst"), "distance")


def validate(edges: DataFrame, n: int, dense: bool) -> None:
    """Ids in range, no repeats, zero diagonal, no negative or NaN, symmetric; finite too unless ``dense``, which is complete."""
    error = InvalidPrecomputed if dense else InvalidSparse
    d = F.col("distance")
    wrong = d.isNull() | F.isnan(d) | (d < 0) | ((F.col("src") == F.col("dst")) & (d != 0))
    if not dense:
        wrong = wrong | (d == float("inf"))
    low = F.least("src", "dst")
    row = edges.agg(F.count("*").alias("m"), F.count_if(wrong).alias("wrong"), F.min(low).alias("lo"), F.max(F.greatest("src", "dst")).alias("hi")).first()
    if row["wrong"]:
        raise error(f"{row['wrong']} entries are negative, not finite, null, or off zero on the diagonal")
    if row["m"] and (row["lo"] < 0 or row["hi"] >= n):
        raise error(f"ids reach from {row['lo']} to {row['hi']} with {n} vertices")
    if dense and row["m"] != n * n:
        raise error(f"{row['m']} entries, not {n * n}")
    pairs = edges.groupBy(low.alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("k"), F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.countDistinct("src").alias("ends"))
    off = pairs.where(((F.col("a") != F.col("b")) & ((F.col("k") != 2) | (F.col("ends") != 2) | (F.col("lo") != F.col("hi")))) | ((F.col("a") == F.col("b")) & (F.col("k") != 1)))
    bad = off.limit(1).collect()
    if bad:
        raise error(f"entries of {bad[0]['a']} and {bad[0]['b']} repeat or aren't symmetric")


Row = tuple[int, np.ndarray | None, np.ndarray]


@dataclass(frozen=True)
class Rows:
    """A symmetric graph by rows, made where they are read.

    ``read`` turns batches of ``df`` into (vertex, other vertices ascending, distances), once
    for each vertex that has edges; None in place of the others means all vertices in order,
    a row of a matrix. Rows are read more than once and have to be the same each time.
    """

    df: DataFrame
    read: Callable[[Iterator[pa.RecordBatch]], Iterator[Row]]


def matrix_rows(df: DataFrame) -> Rows:
    """Of (id, features) with a row of a square matrix each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield i, None, row.values.to_numpy(zero_copy_only=False).astype(float)

    return Rows(df.select("id", "features"), read)


def distance_rows(points: DataFrame, first: int, width: int, metric: Metric) -> Rows:
    """The matrix of all distances of vectors, whose ids count from ``first``; the vectors go with the task."""
    table = points.select("id", "features").toArrow().sort_by("id")
    base = points.sparkSession.sparkContext.broadcast(table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, max(1, width)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        x = np.asfortranarray(base.value)
        step = max(1, (1 << 18) // max(1, len(x)))
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for at in range(0, len(ids), step):
                for i, d in zip(ids[at : at + step].tolist(), metric.kernel(q[at : at + step], x), strict=True):
                    yield i - first, None, d

    return Rows(_over_cores(points.select("id", "features")), read)


def group_rows(members: DataFrame, n: int, link: float) -> Rows:
    """Of (id, value, number of a group): members of a group are joined at the difference of their values, and each of ``n`` vertices to the next at ``link`` if that is less or they share no group."""
    table = members.select("id", "value", "group").toArrow().sort_by("id")
    held = members.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("id", "value", "group")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        ids, value, group = held.value
        groups = {g: (ids[group == g], value[group == g]) for g in np.unique(group)}
        for batch in batches:
            for i in batch.column(0).to_pylist():
                own = int(np.searchsorted(ids, i))
                others, d = ids[:0], value[:0]
                if own < len(ids) and ids[own] == i:
                    others, d = groups[group[own]]
                    at = int(np.searchsorted(others, i))
                    d = np.abs(d - value[own])
                    others, d = np.delete(others, at), np.delete(d, at)
                for j in (i - 1, i + 1):
                    if 0 <= j < n:
                        at = int(np.searchsorted(others, j))
                        if at < len(others) and others[at] == j:
                            d[at] = min(d[at], link)
                        else:
                            others, d = np.insert(others, at, j), np.insert(d, at, link)
                yield i, others, d

    return Rows(_over_cores(members.sparkSession.range(n)), read)


def _over_cores(df: DataFrame) -> DataFrame:
    """A few parts for each core, each of which keeps a forest."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
