"""Vectors as DataFrames: (id BIGINT, features ARRAY<DOUBLE>)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidShape, NonFinite


def vectors(df: DataFrame, id_column: str, features: str | Sequence[str]) -> DataFrame:
    """From an array column, or from several numeric columns."""
    if isinstance(features, str):
        values = F.col(features).cast("array<double>")
    else:
        values = F.array(*(F.col(c).cast("double") for c in features))
    return df.select(F.col(id_column).cast("long").alias("id"), values.alias("features"))


@dataclass(frozen=True)
class Shape:
    rows: int
    columns: int


def _bad(x):
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def validate(df: DataFrame, least_rows: int = 0, columns: int | None = None) -> Shape:
    """One aggregation: equal lengths, finite values, unique ids. Null vectors and values count as not finite."""
    row = df.agg(
        F.count("*").alias("n"),
        F.min(F.size("features")).alias("lo"),
        F.max(F.size("features")).alias("hi"),
        F.min(F.when(F.col("features").isNull() | F.exists("features", _bad), F.col("id"))).alias("bad"),
        F.count_if(F.col("id").isNull() | F.col("features").isNull()).alias("nulls"),
    ).first()
    if row["nulls"]:
        raise NonFinite(f"{row['nulls']} rows have a null id or vector")
    if row["bad"] is not None:
        raise NonFinite(f"the vector of id {row['bad']} has a value that isn't finite")
    if row["n"] and row["lo"] != row["hi"]:
        raise InvalidShape(f"vectors have {row['lo']} to {row['hi']} columns")
    if columns is not None and row["n"] and row["hi"] != columns:
        raise InvalidShape(f"vectors have {row['hi']} columns, not {columns}")
    if row["n"] < least_rows:
        from ..errors import TooFewPoints

        raise TooFewPoints(f"{row['n']} rows")
    return Shape(row["n"], row["hi"] or 0)
