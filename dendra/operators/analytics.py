"""Analytics of condensed trees, relational throughout.

``condensed`` is (parent, child, lambda_val, child_size); ``n`` is the number of points
and the id of the root. Cluster rows (child_size over 1, or child at least n) are few;
ancestors are found by doubling self-joins over them alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut as cut_lineage
from ..plans.lineage import stored

_INF = float("inf")


def cluster_rows(condensed: DataFrame, n: int) -> DataFrame:
    return condensed.where(F.col("child") >= n)


def births(condensed: DataFrame, n: int) -> DataFrame:
    """(cluster, birth): the density at which a cluster splits off; zero for the root."""
    born = cluster_rows(condensed, n).groupBy(F.col("child").alias("cluster")).agg(F.min("lambda_val").alias("birth"))
    return born.unionByName(condensed.sparkSession.range(1).select(F.lit(n).cast("long").alias("cluster"), F.lit(0.0).alias("birth")))


def stabilities(condensed: DataFrame, n: int) -> DataFrame:
    """(cluster, stability): rows' sizes times density beyond the cluster's birth; NaN where both are infinite."""
    rows = condensed.join(births(condensed, n), condensed["parent"] == F.col("cluster"))
    gain = F.when((F.col("lambda_val") == _INF) & (F.col("birth") == _INF), F.lit(float("nan"))).otherwise(F.col("lambda_val") - F.col("birth"))
    return rows.groupBy("cluster").agg(F.sum(gain * F.col("child_size")).alias("stability"))


def own_peaks(condensed: DataFrame) -> DataFrame:
    """(cluster, peak): the largest density among a cluster's own rows."""
    return condensed.groupBy(F.col("parent").alias("cluster")).agg(F.max("lambda_val").alias("peak"))


def ancestors(condensed: DataFrame, n: int) -> DataFrame:
    """(cluster, ancestor): all clusters at or above each cluster. Doubling: rounds are the logarithm of the depth."""
    step = cluster_rows(condensed, n).select(F.col("child").alias("cluster"), F.col("parent").alias("ancestor")).distinct()
    ids = condensed.select(F.col("parent").alias("cluster")).union(step.select("cluster")).distinct()
    closed = cut_lineage(ids.select("cluster", F.col("cluster").alias("ancestor")).union(step))
    size = closed.count()
    while True:
        upper = closed.select(F.col("cluster").alias("ancestor"), F.col("ancestor").alias("upper"))
        closed = cut_lineage(closed.join(upper, "ancestor").select("cluster", F.col("upper").alias("ancestor")).distinct())
        grown = closed.count()
        if grown == size:
            return closed
        size = grown


def subtree_peaks(condensed: DataFrame, n: int, above: DataFrame | None = None) -> DataFrame:
    """(cluster, peak): the largest density in a cluster or below it. ``above``: the ancestors, if they are known."""
    own = own_peaks(condensed)
    return (ancestors(condensed, n) if above is None else above).join(own, "cluster").groupBy(F.col("ancestor").alias("cluster")).agg(F.max("peak").alias("peak"))


def leaves(condensed: DataFrame, n: int) -> DataFrame:
    """(cluster): clusters without clusters below; never the root."""
    inner = cluster_rows(condensed, n).select(F.col("parent").alias("cluster"))
    return cluster_rows(condensed, n).select(F.col("child").alias("cluster")).join(inner, "cluster", "left_anti")


def number_clusters(selected: DataFrame) -> DataFrame:
    """(cluster, label): labels by ascending cluster id."""
    return selected.select("cluster", (F.row_number().over(Window.orderBy("cluster")) - 1).cast("int").alias("label"))


def share_of_peak(density: Column, peak: Column) -> Column:
    return F.when((peak == 0) | (density == _INF), 1.0).otherwise(F.least(density, peak) / F.nullif(peak, F.lit(0.0)))


def points(condensed: DataFrame, selected: DataFrame, n: int) -> DataFrame:
    """(id, label, probability, outlier_score) by the lowest selected cluster at or above each point."""
    above = ancestors(condensed, n)
    over = above.join(selected.select(F.col("cluster").alias("ancestor")), "ancestor").groupBy("cluster").agg(F.max("ancestor").alias("chosen"))
    peaks = subtree_peaks(condensed, n, above)
    own = condensed.where(F.col("child") < n).select(F.col("child").alias("id"), F.col("parent").alias("cluster"), "lambda_val")
    rows = own.join(over, "cluster", "left").join(number_clusters(selected).select(F.col("cluster").alias("chosen"), "label"), "chosen", "left")
    rows = rows.join(peaks.select("cluster", F.col("peak").alias("peak_parent")), "cluster").join(peaks.select(F.col("cluster").alias("chosen"), F.col("peak").alias("peak_chosen")), "chosen", "left")
    top = F.col("peak_parent")
    outlier = F.when((top == 0) | (F.col("lambda_val") == _INF), 0.0).when(top == _INF, F.lit(float("nan"))).otherwise((top - F.col("lambda_val")) / F.nullif(top, F.lit(0.0)))
    return rows.select("id", F.coalesce("label", F.lit(-1)).alias("label"), F.when(F.col("label").isNull(), 0.0).otherwise(share_of_peak(F.col("lambda_val"), F.col("peak_chosen"))).alias("probability"), outlier.alias("outlier_score"))


def persistences(condensed: DataFrame, selected: DataFrame, n: int) -> DataFrame:
    """(cluster, label, size, persistence): stability over size times the largest density of all; 1 where that says nothing."""
    counts = points(condensed, selected, n).where("label >= 0").groupBy("label").agg(F.count("*").alias("size"))
    most = condensed.agg(F.max("lambda_val").alias("most"))
    rows = number_clusters(selected).join(stabilities(condensed, n), "cluster").join(counts, "label", "left").join(F.broadcast(most))  # one row
    size = F.coalesce("size", F.lit(0))
    value = F.when((F.col("most") == 0) | (F.col("most") == _INF) | (size == 0), 1.0).otherwise(F.col("stability") / F.nullif(size * F.col("most"), F.lit(0.0)))
    return rows.select("cluster", "label", size.alias("size"), value.alias("persistence"))


def cut_components(edges: DataFrame, ids: DataFrame, cut: float, least: int) -> DataFrame:
    """(id, label): components of the edges under ``cut`` by least-label propagation, numbered by first appearance; small ones are -1.

    In each round every end takes its least neighbour's label, labels are followed to
    their ends, and edges inside a label go, so rounds grow with the logarithm of a
    component's size even where it is one long path.
    """
    open_ = stored(edges.where(F.col("distance") < cut).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    label = stored(ids.select("id", F.col("id").alias("root")))
    while open_.limit(1).count():
        both = open_.union(open_.select("b", "a"))
        up = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")))
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = stored(up.join(above, "up").select("node", "up", "top"))
            up = jumped.select("node", F.col("top").alias("up"))
            if not jumped.where("up <> top").limit(1).count():
                break
        label = stored(label.join(up, label["root"] == up["node"], "left").select("id", F.coalesce("up", "root").alias("root")))
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("to_a")), up.select(F.col("node").alias("b"), F.col("up").alias("to_b"))
        open_ = stored(open_.join(a, "a").join(b, "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct())
    sized = label.withColumn("n", F.count("*").over(Window.partitionBy("root")))
    kept = sized.where(F.col("n") >= least).select("root").distinct().withColumn("label", (F.row_number().over(Window.orderBy("root")) - 1).cast("int"))
    return sized.join(kept, "root", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))
