"""Trees and graphs as CSV or newline-delimited JSON, one file, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfig

CSV, JSON = "csv", "json"
#: Columns of each export, in order.
COLUMNS = {
    "mst": (("src", "from"), ("dst", "to"), ("distance", "distance")),
    "linkage": (("left", "left"), ("right", "right"), ("distance", "distance"), ("size", "size")),
    "condensed": (("parent", "parent"), ("child", "child"), ("lambda_val", "lambda"), ("child_size", "child_size")),
    "branch_graph": (("src", "from"), ("dst", "to"), ("centrality", "centrality"), ("reachability", "reachability")),
}


def table(df: DataFrame, kind: str) -> DataFrame:
    if kind not in COLUMNS:
        raise InvalidConfig(f"unknown export {kind!r}")
    order = [c for c in ("cluster", "seq", "src", "dst") if c in df.columns] if kind == "branch_graph" else ["seq"]
    return df.orderBy(*order).select(*(F.col(a).alias(b) for a, b in COLUMNS[kind]))


def write(df: DataFrame, kind: str, path: str, form: str = CSV) -> None:
    """Infinite densities are written as Infinity in CSV and as that string in JSON."""
    out = table(df, kind).coalesce(1)
    if form == CSV:
        out.write.mode("overwrite").option("header", True).csv(path)
    elif form == JSON:
        out.write.mode("overwrite").json(path)
    else:
        raise InvalidConfig(f"unknown export format {form!r}")
