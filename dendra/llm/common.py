"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words everywhere in this subpackage: space and bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder (a temporary one only where none is set and the master is local)."""
    return f"{_checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def _checkpoint_root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage; survives lost executors."""
    _checkpoint_root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, but read again from Parquet: rows that went through several rounds of ``cut`` carry constraints that planning multiplies."""
    path = shared_dir(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: A side of keys is broadcast up to this many rows, by a count taken first.
BROADCAST_ROWS = 500_000


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key isn't in ``gone`` (distinct keys, materialised): by broadcast if these are few, else by a shuffled join."""
    few = gone.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(gone) if few else gone, key, "left_anti")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z only; other letters stay as they are."""
    return F.translate(text, _ASCII_UPPER, _ASCII_UPPER.lower())


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) reduced to one link per node, to the least node it is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable over ``links``, for every node that has a link.

    In each round every node takes its least neighbour's label, labels are followed to
    their ends by pointer jumping, and links inside a label go, so that a long path takes
    few rounds. Labels are written to the shared folder and read again, as checkpointed
    rows carry constraints that planning on the driver multiplies with each round.
    """
    open_ = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    label = None
    while label is None or open_.limit(1).count():
        both = open_.union(open_.select("v", "u"))
        up = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near")).select("node", F.least("node", "near").alias("up")))
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = stored(up.join(above, "up").select("node", "up", "top"))
            up = jumped.select("node", F.col("top").alias("up"))
            if not jumped.where("up <> top").limit(1).count():
                break
        if label is None:
            label = up.select("node", F.col("up").alias("component"))
        else:
            top = up.select(F.col("node").alias("component"), F.col("up").alias("top"))
            label = stored(label.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")))
        x, y = (up.select(F.col("node").alias(c), F.col("up").alias(f"to_{c}")) for c in "uv")
        open_ = stored(open_.join(x, "u").join(y, "v").where("to_u <> to_v").select(F.col("to_u").alias("u"), F.col("to_v").alias("v")).distinct())
    return label
