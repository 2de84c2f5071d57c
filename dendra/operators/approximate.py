"""Approximate trees from a pluggable neighbour graph.

The own backend sorts the points along four fixed projections; those within a window of
places are candidates. Projections, windows and candidates are columns, distances are
expressions, and only the edges of the graph meet in one task.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Disconnected, InvalidShape
from ..functions.metrics import Metric
from ..plans.config import Config
from ..plans.lineage import cut
from ..sources.vectors import Shape
from .neighbors import reachability

#: With the multipliers and the shift they decide the candidates, and so the results.
PROJECTIONS = 4
_M = (1 << 64) - 1
_BY_DIMENSION, _BY_PROJECTION, _SHIFT = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 61


class Backend(Protocol):
    def build(self, df: DataFrame, metric: Metric, k: int, alpha: float, shape: Shape) -> tuple[DataFrame, DataFrame]:
        """(id, core) of all points, and (src, dst, distance) of a connected graph of mutual reachability."""


def coefficient(projection: int, dimension: int) -> int:
    """Between -4 and 3, from a hash of both numbers."""
    h = ((dimension + 1) * _BY_DIMENSION + (projection + 1) * _BY_PROJECTION) & _M
    return (h >> _SHIFT) - 4


#: Rows up to which one task numbers them; beyond, they are numbered range by range. The places are the same.
ONE_TASK_ROWS = 200_000


def places(df: DataFrame, rows: int) -> DataFrame:
    """(id, place): places from 1 in the order of (value, id)."""
    if rows <= ONE_TASK_ROWS:
        return df.select("id", F.row_number().over(Window.orderBy("value", "id")).alias("place"))
    ranged = cut(df.repartitionByRange("value", "id").withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    ahead = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", before).select("part", "before")
    own = F.row_number().over(Window.partitionBy("part").orderBy("value", "id"))
    return ranged.withColumn("own", own).join(F.broadcast(ahead), "part").select("id", (F.col("own") + F.col("before")).cast("long").alias("place"))


class Projections:
    def __init__(self, candidates: int = 0):
        self.candidates = candidates

    def window(self, k: int, rows: int) -> int:
        wanted = min(self.candidates or max(128, 8 * k), rows - 1)
        return max(1, -(-wanted // PROJECTIONS) // 2)

    def pairs(self, df: DataFrame, k: int, shape: Shape) -> DataFrame:
        """(a, b): b is a candidate of a; if there are fewer than k, the smallest ids fill up."""
        width = self.window(k, shape.rows)
        found = None
        for p in range(PROJECTIONS):
            factors = F.array(*(F.lit(float(coefficient(p, d))) for d in range(shape.columns)))
            value = F.aggregate(F.zip_with("features", factors, lambda x, c: x * c), F.lit(0.0), lambda s, v: s + v)
            placed = places(df.select("id", value.alias("value")), shape.rows)
            near = placed.select(F.col("id").alias("a"), F.explode(F.sequence(F.col("place") - width, F.col("place") + width)).alias("place"))
            part = near.join(placed.select(F.col("id").alias("b"), "place"), "place").select("a", "b")
            found = part if found is None else found.union(part)
        found = found.where("a <> b").distinct()
        counts = found.groupBy("a").agg(F.count("*").alias("held"))
        few = df.select(F.col("id").alias("a")).join(counts, "a", "left").where(F.coalesce("held", F.lit(0)) < k)
        smallest = df.select(F.col("id").alias("b")).orderBy("b").limit(2 * k + 1)  # at most k of them are held already, and one is the point
        more = few.join(F.broadcast(smallest), F.col("a") != F.col("b")).join(found, ["a", "b"], "left_anti")
        ranked = more.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where(F.col("rank") <= F.lit(k) - F.coalesce("held", F.lit(0)))
        return found.union(ranked.select("a", "b"))

    def build(self, df: DataFrame, metric: Metric, k: int, alpha: float, shape: Shape) -> tuple[DataFrame, DataFrame]:
        pairs = self.pairs(df, k, shape)
        both = pairs.join(df.select(F.col("id").alias("a"), F.col("features").alias("x")), "a").join(df.select(F.col("id").alias("b"), F.col("features").alias("y")), "b")
        near = both.select("a", "b", metric.distance(F.col("x"), F.col("y")).alias("distance")).persist()
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b")))
        core = ranked.where(F.col("rank") <= k).groupBy(F.col("a").alias("id")).agg(F.max("distance").alias("core"))
        upper = near.where("a < b").join(core.select(F.col("id").alias("a"), F.col("core").alias("core_a")), "a").join(core.select(F.col("id").alias("b"), F.col("core").alias("core_b")), "b")
        return core, upper.select(F.col("a").alias("src"), F.col("b").alias("dst"), reachability(F.col("distance"), F.col("core_a"), F.col("core_b"), alpha).alias("distance"))


def fit_rows(df: DataFrame, config: Config, shape: Shape) -> DataFrame:
    from ..plans.model import _single_task, edge_kernel

    backend: Backend = config.approximate_backend or Projections(config.approximate_candidates)
    core, edges = backend.build(df, config.metric, min(config.min_samples, shape.rows - 1), config.alpha, shape)
    known = df.select("id").join(core.select("id", "core"), "id", "full_outer").join(df.select("id", F.lit(True).alias("there")), "id", "left")
    bad = known.where(F.col("there").isNull() | F.col("core").isNull() | ~((F.col("core") >= 0) & (F.col("core") < float("inf")))).limit(1).count()
    if bad or core.count() != shape.rows:
        raise InvalidShape("the backend gave core distances for other points, or such as are negative or not finite")
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    if ends.join(df.select("id"), "id", "left_anti").limit(1).count():
        raise InvalidShape("the backend gave an edge of another point")
    wrong = edges.where((F.col("src") == F.col("dst")) | F.col("distance").isNull() | F.isnan("distance") | (F.col("distance") < 0) | (F.col("distance") == float("inf"))).limit(1).count()
    if wrong:
        raise Disconnected("the backend gave an edge that isn't finite, or a loop")
    named = edges.unionByName(df.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("distance")))
    return _single_task(named, edge_kernel(config))
