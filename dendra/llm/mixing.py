"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations alone.

A source's target in words gives complete epochs of all its documents, and a rest
that is filled in the order of exponential keys scaled by the documents' quality
weights. The running sum is taken in two steps: sums of key ranges first (a small
table), then the rows of the one range in which the budget ends; no source, however
large, is sorted or summed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_of

#: Weights of the sources in the order of their names' code points, repeating; null comes last.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is repeated so often at most.
EPOCHS = 3.0
_RANGES = 4096


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of characters that are neither capitals, digits nor marks."""
    plain = F.length(F.regexp_replace(text, r"[^\p{Ll}\x20\x09-\x0D]", ""))
    return F.lit(0.1) + 0.9 * F.coalesce(plain / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def uniform(seed: int, column: str = "doc_id") -> Column:
    """A number in (0, 1) from the id alone, so that reruns agree, and so do other engines."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col(column).cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """source, source_size, target, from source and source_size: 100 % of all words by weight, none over ``epochs`` times its size.

    What a source can't take is shared by weight among the others until none is above.
    In the order of size over weight the sources that stop come first, so one running
    sum finds them all. A source without words has the target 0.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    named = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))).withColumn("most", F.lit(epochs) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    spread = named.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = F.col("rest") / F.col("weights")
    stops = F.col("most") <= level * F.col("weight")
    open_level = F.min(F.when(~stops, F.struct(F.col("most") / F.col("weight"), level.alias("level")))).over(everything)["level"]
    return spread.select("source", "source_size", F.when(stops, F.col("most")).otherwise(F.col("weight") * open_level).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, seed: int = 17, quality: Column | None = None) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and taken, the words that the mix takes, repeats counted.

    taken is the size times the complete epochs, and again the size for documents within
    the rest of the budget; the document at which the budget ends gives as many words as
    are left. Null texts have no words; null sources are one source, the last. Repeated
    rows are documents of their own, and ties are broken by doc_id and text. Texts are
    read once and never shuffled. Other columns are not looked at.
    """
    text = text_of()
    weight = quality_weight(text) if quality is None else quality
    key = -F.log(uniform(seed)) / weight  # exponential, the smaller the heavier
    small = docs.select("doc_id", "source", words(text).alias("size"), F.xxhash64("doc_id", "text", "source").alias("__row"), key.alias("__key"))
    small = cut(small.withColumn("__range", F.least(F.lit(_RANGES - 1), F.floor(F.lit(float(_RANGES)) * F.col("__key") / (F.col("__key") + 1))).cast("int")))
    ranges = cut(small.groupBy("source", "__range").agg(F.sum("size").alias("sum")))
    goals = targets(ranges.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, epochs)
    budget = goals.select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("full"),
    ).withColumn("left", F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long"))
    running = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = ranges.withColumn("upto", F.sum("sum").over(running)).withColumn("before", F.col("upto") - F.col("sum")).withColumnRenamed("__range", "r")
    plan = cut(upto.join(budget, upto["source"].eqNullSafe(budget["s"])).select(F.col("source").alias("s"), "r", "source_size", "target", "full", "left", "before", "upto"))
    placed = small.join(plan, small["source"].eqNullSafe(plan["s"]) & (small["__range"] == plan["r"])).drop("s", "r")
    whole = placed.where("upto <= left OR before >= left").withColumn("part", F.when(F.col("upto") <= F.col("left"), F.col("size")).otherwise(0))
    within = Window.partitionBy("source").orderBy("__key", "doc_id", "__row").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where("upto > left AND before < left").withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0)))))
    return whole.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("part")).cast("long").alias("taken"))
