"""Comparisons of partitions, relational throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical_labels(points: DataFrame) -> DataFrame:
    """(id, label): clusters numbered by first appearance in the order of ids; noise stays -1."""
    first = points.where("label >= 0").groupBy("label").agg(F.min("id").alias("first"))
    number = first.select("label", (F.row_number().over(Window.orderBy("first")) - 1).alias("number"))
    return points.join(number, "label", "left").select("id", F.coalesce("number", F.lit(-1)).alias("label"))


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, level, n): counts of pairs of labels, of each label alone, and of all, by grouping sets."""
    both = a.select("id", F.col("label").alias("a")).join(b.select("id", F.col("label").alias("b")), "id")
    return both.groupingSets([["a", "b"], ["a"], ["b"], []], "a", "b").agg(F.grouping_id("a", "b").alias("level"), F.count("*").alias("n")).select("a", "b", F.col("level").cast("int").alias("level"), "n")


def adjusted_rand_index(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ari): one row; noise counts as a cluster of its own; 1 under two points."""
    pairs = F.col("n") * (F.col("n") - 1) / 2
    s = contingency(a, b).agg(*(F.coalesce(F.sum(F.when(F.col("level") == level, pairs)), F.lit(0.0)).alias(name) for level, name in ((0, "joint"), (1, "rows"), (2, "cols"), (3, "total"))))
    expected = F.col("rows") * F.col("cols") / F.nullif("total", F.lit(0.0))
    most = (F.col("rows") + F.col("cols")) / 2
    even = F.when((F.col("joint") == F.col("rows")) & (F.col("joint") == F.col("cols")), 1.0).otherwise(0.0)
    return s.select(F.when(F.col("total") == 0, 1.0).when(most == expected, even).otherwise((F.col("joint") - expected) / F.nullif(most - expected, F.lit(0.0))).alias("ari"))


def same_partition(a: DataFrame, b: DataFrame) -> DataFrame:
    """(same): whether the labels differ in names alone."""
    pairs = contingency(a, b).where("level = 0")
    return pairs.agg(((F.count("*") == F.countDistinct("a")) & (F.count("*") == F.countDistinct("b"))).alias("same"))


def edge_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall): the share of the exact edges that were found, whichever way they point."""
    ends = (F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    hit = exact.select(*ends).join(found.select(*ends).distinct().withColumn("hit", F.lit(1)), ["a", "b"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def pair_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(agreement): the share of pairs of points on which both say together, or both apart; from counts, not pairs."""
    pairs = F.col("n") * (F.col("n") - 1) / 2
    s = contingency(a, b).agg(*(F.coalesce(F.sum(F.when(F.col("level") == level, pairs)), F.lit(0.0)).alias(name) for level, name in ((0, "joint"), (1, "rows"), (2, "cols"), (3, "total"))))
    return s.select(F.coalesce(1 - (F.col("rows") + F.col("cols") - 2 * F.col("joint")) / F.nullif("total", F.lit(0.0)), F.lit(1.0)).alias("agreement"))
