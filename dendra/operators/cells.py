"""Cells of space for neighbour joins: vectors near each other share a cell, and a cell meets only those whose boxes are near enough.

The cuts come of a bounded sample and bear on speed alone. A row needs no more than its
k-th distance in one cell, or the farthest corner distance within which cells hold k rows
for certain; it meets no cell whose box begins beyond that. Boxes, one for each cell, go
with the tasks; vectors meet by an equi-join on cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Metric
from ..plans.lineage import cut
from ..sources.vectors import Shape

#: Metrics whose distance of two points is no less than that of the gaps between boxes around them, and dimensions up to which boxes tell.
BOXED, COLUMNS = ("euclidean", "sqeuclidean", "manhattan", "chebyshev"), 32
#: Rows that place the cuts, at most about so many.
SAMPLE = 50_000
#: What rounding may take from a distance between boxes.
SLACK = 1e-9
_CELL = "block int, ids binary, x binary, low binary, high binary"
#: Rows of a cell at most: smaller ones hold fewer pairs, and have more boxes to hold them against.
ROWS = 512
#: Rows from which cells are worth their jobs.
LEAST_ROWS = 20_000


def serves(metric: Metric, columns: int) -> bool:
    return (metric.name in BOXED or metric.name.startswith("minkowski")) and 0 < columns <= COLUMNS


def cuts(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of the nodes of a whole binary tree, those below node i at 2i + 1 and 2i + 2; halves along the widest coordinate."""
    nodes = (1 << depth) - 1
    axis, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
    held = {0: np.arange(len(x))}
    for node in range(nodes):
        own = held.pop(node, np.zeros(0, np.int64))
        if len(own) < 2:
            continue
        axis[node] = np.ptp(x[own], axis=0).argmax()
        value[node] = np.median(x[own, axis[node]])
        right = x[own, axis[node]] > value[node]
        held[2 * node + 1], held[2 * node + 2] = own[~right], own[right]
    return axis, value


def place(x: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    node = np.zeros(len(x), np.int64)
    for _ in range((len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[np.arange(len(x)), axis[node]] > value[node])
    return node - len(axis)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def placed(df: DataFrame, axis: np.ndarray, value: np.ndarray, width: int, block_rows: int, more: tuple[str, ...] = ()) -> DataFrame:
    """id, features, block, and columns of doubles ``more``; a leaf that many rows share is dealt into several cells by a hash of the id."""
    leaves = len(axis) + 1
    names, schema = ["id", "features", *more], ", ".join(["id long, features array<double>", *(f"{c} double" for c in more)])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = place(_matrix(batch.column(1), width), axis, value) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*names, "leaf"])

    in_leaf = df.select(*names).mapInArrow(leaf, f"{schema}, leaf int")
    sizes = {r["leaf"]: r["count"] for r in in_leaf.groupBy("leaf").count().collect()}
    parts = np.array([max(1, -(-sizes.get(i, 0) // (2 * block_rows))) for i in range(leaves)])
    first = np.concatenate([[0], np.cumsum(parts)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(len(names)).to_numpy()
            turn = (batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % parts[at].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array((first[at] + turn.astype(np.int64)).astype(np.int32))], names=[*names, "block"])

    return in_leaf.mapInArrow(deal, f"{schema}, block int")


def _packed(df: DataFrame, axis: np.ndarray, value: np.ndarray, width: int, block_rows: int) -> DataFrame:
    """Cells as packed rows."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        x = _matrix(table.column("features"), width)
        row = {"block": [key[0].as_py()], "ids": [table.column("id").to_numpy().tobytes()], "x": [x.tobytes()], "low": [x.min(axis=0).tobytes()], "high": [x.max(axis=0).tobytes()]}
        return pa.table(row, schema=pa.schema([("block", pa.int32()), *((c, pa.binary()) for c in ("ids", "x", "low", "high"))]))

    return placed(df, axis, value, width, block_rows).groupBy("block").applyInArrow(pack, _CELL)


def near_cells(low: np.ndarray, high: np.ndarray, boxes: tuple[np.ndarray, ...], k: int, metric: Metric) -> tuple[np.ndarray, float]:
    """How far each cell of ``boxes`` (block, rows, low, high) begins from the box, and a distance within which any point in the box has k rows."""
    _, rows, lows, highs = boxes
    zero = np.zeros((1, len(low)))
    least = metric.kernel(zero, np.maximum(0, np.maximum(lows - high, low - highs)))[0]
    most = metric.kernel(zero, np.maximum(np.abs(lows - high), np.abs(highs - low)))[0]
    order = np.argsort(most, kind="stable")
    enough = np.searchsorted(np.cumsum(rows[order]), k)
    return least, most[order[enough]] if enough < len(order) else np.inf


def asked_cells(x: np.ndarray, home: int, base: np.ndarray, boxes: tuple[np.ndarray, ...], k: int, metric: Metric) -> Iterator[tuple[int, np.ndarray]]:
    """Each cell of ``boxes`` (by its place) that may hold one of the k nearest rows of some ``x``, and the places of those; ``base`` are the vectors of the cell ``home``.

    A row's k-th distance in that one cell bounds how far it has to look.
    """
    _, _, lows, highs = boxes
    least, bound = near_cells(x.min(axis=0), x.max(axis=0), boxes, k, metric)
    most = np.full(len(x), bound)
    if len(base) >= k:
        most = np.minimum(most, np.partition(metric.kernel(x, base), k - 1, axis=1)[:, k - 1])
    most *= 1 + SLACK
    yield home, np.arange(len(x))
    for cell in np.flatnonzero(least <= most.max()).tolist():
        if cell != home:
            gap = metric.kernel(np.zeros((1, x.shape[1])), np.maximum(0, np.maximum(lows[cell] - x, x - highs[cell])))[0]
            near = np.flatnonzero(gap <= most)
            if len(near):
                yield cell, near


def sampled_cuts(base: DataFrame, shape: Shape, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts for cells of about ``block_rows`` rows, by a sample."""
    depth = max(0, (-(-shape.rows // block_rows) - 1).bit_length())
    rate = max(1, shape.rows // SAMPLE)
    sample = base.where(F.pmod(F.xxhash64("id"), F.lit(rate)) == 0).select("features").toArrow()
    return cuts(_matrix(sample.column(0), shape.columns) if sample.num_rows else np.zeros((0, shape.columns)), depth)


def pairs(queries: DataFrame, base: DataFrame, k: int, metric: Metric, shape: Shape, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(ids, x, other) of the queries of a cell that have to meet each other cell, and (block, ids, x) of the base's."""
    width, block_rows = shape.columns, min(block_rows, ROWS)
    parts = parts_of(base, -(-shape.rows // block_rows))
    axis, value = sampled_cuts(base, shape, block_rows)
    right = cut(_packed(base, axis, value, width, block_rows).repartition(parts))
    table = right.select("block", (F.length("ids") / 8).cast("long").alias("rows"), "low", "high").toArrow().sort_by("block")
    corners = (np.array([np.frombuffer(v, float) for v in table.column(c).to_pylist()]).reshape(-1, width) for c in ("low", "high"))
    held = base.sparkSession.sparkContext.broadcast((table.column("block").to_numpy(), table.column("rows").to_numpy(), *corners))

    def housed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, _, lows, highs = held.value
        for batch in batches:
            for i in range(batch.num_rows):
                middle = (np.frombuffer(batch.column("low")[i].as_py()) + np.frombuffer(batch.column("high")[i].as_py())) / 2
                gap = np.maximum(0, np.maximum(lows - middle, middle - highs))
                home = block[metric.kernel(np.zeros((1, width)), gap)[0].argmin()]
                yield pa.RecordBatch.from_arrays([pa.array([home], pa.int32()), *(batch.column(c).slice(i, 1) for c in ("ids", "x"))], names=["block", "ids", "x"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = held.value
        for batch in batches:
            for home, ids, x, y in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "x", "base_x")), strict=True):
                ids, x, y = np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(-1, width), np.frombuffer(y).reshape(-1, width)
                for other, near in asked_cells(x, int(np.searchsorted(boxes[0], home)), y, boxes, k, metric):
                    yield pa.RecordBatch.from_pydict({"ids": [ids[near].tobytes()], "x": [x[near].tobytes()], "other": [int(boxes[0][other])]}, schema=pa.schema([("ids", pa.binary()), ("x", pa.binary()), ("other", pa.int32())]))

    if queries is base:
        mine = right.select("block", "ids", "x", F.col("x").alias("base_x"))
    else:
        mine = _packed(queries, axis, value, width, block_rows).mapInArrow(housed, "block int, ids binary, x binary")
        mine = mine.repartition(parts, "block").join(right.select("block", F.col("x").alias("base_x")).repartition(parts, "block"), "block")
    left = mine.mapInArrow(met, "ids binary, x binary, other int")
    return left.repartition(parts, "other"), right.select("block", "ids", "x").repartition(parts, "block")


def parts_of(df: DataFrame, blocks: int) -> int:
    """Partitions for so many blocks: over all cores, of eight blocks where there are many."""
    return max(4 * df.sparkSession.sparkContext.defaultParallelism, blocks // 8)
