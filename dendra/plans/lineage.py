"""Cutting lineage in iterative plans."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame


def _shared(df: DataFrame) -> str:
    """The shared folder named by spark.checkpoint.dir (a temporary one only where none is set and the master is local)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder."""
    _shared(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, but read again from Parquet: rows that went through several rounds of ``cut`` carry constraints that planning multiplies."""
    path = f"{_shared(df)}/rows-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
