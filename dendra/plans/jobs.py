"""Cancellation: all jobs of a block run in one group, which another thread may cancel."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def cancellable(spark: SparkSession, group: str) -> Iterator[None]:
    """Jobs started inside belong to ``group``; after :func:`cancel` the running action raises."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group, interruptOnCancel=True)
    try:
        yield
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)
