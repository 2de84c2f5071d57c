"""Robust single linkage: the same tree over reachability, cut at a distance."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfig
from ..plans.config import Config, RobustConfig
from .tree import Linkage, cut_labels


@dataclass
class RobustResult:
    labels: DataFrame
    linkage: DataFrame
    mst: DataFrame


def cut_linkage(linkage: DataFrame, points: DataFrame, cut: float, least: int) -> DataFrame:
    """(id, label) of the components of merges under ``cut``; ``points`` are (id), in whose order the linkage counts them."""
    if least < 1 or not 0 <= cut < float("inf"):
        raise InvalidConfig("the cut has to be finite and not negative, the least size 1 at least")
    rows = linkage.select(F.lit(False).alias("point"), "seq", F.col("left").alias("a"), F.col("right").alias("b"), F.col("distance").alias("x"), F.col("size").alias("n"))
    named = points.select(F.lit(True).alias("point"), F.col("id").alias("seq"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("x"), F.lit(1).cast("long").alias("n"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        merges = table.filter(pa.compute.invert(table.column("point")))
        ids = table.filter(table.column("point")).column("seq").to_numpy()
        link = Linkage(*(merges.column(c).to_numpy() for c in ("a", "b", "x", "n")))
        return pa.table({"id": ids, "label": pa.array(cut_labels(link, cut, least), pa.int32())})

    return rows.unionByName(named).groupBy().applyInArrow(run, "id long, label int")


def robust_single_linkage(df: DataFrame, config: RobustConfig) -> RobustResult:
    from ..plans.model import fit

    config = config.validated()
    model = fit(df, Config(min_cluster_size=max(2, config.gamma), min_samples=config.k, alpha=config.alpha, metric=config.metric, algorithm="bruteforce"))
    return RobustResult(cut_linkage(model.linkage, df.select("id"), config.cut, config.gamma), model.linkage, model.mst)
