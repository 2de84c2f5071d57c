"""Nearest neighbours, core distances and mutual reachability.

Vectors are packed into blocks. A small base side, its size checked, is broadcast (one
of many rows only where cells don't serve, as all pairs would be met) and
each block of queries finds its neighbours in one pass; a larger one is joined block by
block on an equi-key, each pair of blocks giving k candidates a row, merged by a window.
For metrics that grow with every coordinate's gap the blocks are cells of space, of which
only those meet that are near enough (see ``cells``).
Distances are folded in coordinate order, so the physical choice never changes a value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidDistance, InvalidShape
from ..functions.metrics import Metric, by_products, paired, squares
from ..plans.lineage import stored
from ..sources.vectors import Shape
from . import cells

#: Bytes of vectors that are broadcast at most.
BROADCAST_BYTES = 32 << 20
#: Values of a base's block, at most about so many, where all blocks meet.
BLOCK_VALUES = 1 << 19


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest(ids: np.ndarray, x: np.ndarray, base_ids: np.ndarray, base: np.ndarray, k: int, metric: Metric, keep_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, distance): the k nearest of a block by (distance, id), in that order."""
    own = ids[:, None] == base_ids[None, :] if not keep_self else np.zeros((len(ids), len(base_ids)), bool)
    if by_products(metric, x.shape[1]) and (near := _near(x, base, own, k)) is not None:
        row, col = near
        return _ranked(ids, base_ids, row, col, paired(metric, x[row], base[col]), k)
    d = metric.kernel(x, base)
    if metric.name != "euclidean" and not ((d >= 0) & (d < np.inf) | own).all():
        raise InvalidDistance(f"{metric.name} gave a distance that is negative or not finite")
    d[own] = np.nan
    k = min(k, len(base_ids))
    if k < len(base_ids):
        kth = np.partition(np.where(np.isnan(d), np.inf, d), k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero(d <= kth[:, None])  # ties at the boundary are all held until they are ranked
    else:
        row, col = np.nonzero(~np.isnan(d))
    return _ranked(ids, base_ids, row, col, d[row, col], k)


def _near(x: np.ndarray, base: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows and columns among which are the k nearest of each row with all ties, but for ``own``, and few others; None where products can't tell."""
    if k + 1 >= len(base) or (found := squares(x, base)) is None:
        return None
    s, off = found
    s[own] = np.inf
    groups = max(4 * k, 64)
    part = len(base) // groups
    if part > 1:  # k rows lie within the k-th of the groups' least distances
        least = s[:, : groups * part].reshape(len(x), groups, part).min(axis=2)
    else:
        least = s
    most = np.partition(least, k - 1, axis=1)[:, k - 1] + 2 * off
    if not np.isfinite(most).all():
        return None
    at = np.flatnonzero(s <= most[:, None])
    return np.divmod(at, len(base)) if len(at) * 4 <= s.size else None


def _ranked(ids: np.ndarray, base_ids: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((base_ids[col], value, row))
    row, col, value = row[order], col[order], value[order]
    first = np.searchsorted(row, np.arange(len(ids)))
    take = np.arange(len(row)) - first[row] < k
    return ids[row[take]], base_ids[col[take]], value[take]


_PAIR = "id long, nbr long, distance double"


def _found(ids: np.ndarray, nbr: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(nbr), pa.array(d)], names=["id", "nbr", "distance"])


def knn(queries: DataFrame, base: DataFrame, k: int, metric: Metric, shape: Shape, keep_self: bool = False, block_rows: int = 1024) -> DataFrame:
    """(id, rank, nbr, distance): ranks from 1 by (distance, nbr). ``shape`` is that of ``base``; rows with the query's own id are left out unless ``keep_self``."""
    width = shape.columns
    in_cells = cells.serves(metric, width)
    if shape.rows * (width + 1) * 8 <= BROADCAST_BYTES and not (in_cells and shape.rows > cells.LEAST_ROWS):
        held = queries.sparkSession.sparkContext.broadcast(_collected(base, width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base_ids, b = held.value
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                x = _matrix(batch.column(1), width)
                step = max(1, min(block_rows, (1 << 22) // max(1, len(base_ids))))
                for at in range(0, len(ids), step):
                    yield _found(*nearest(ids[at : at + step], x[at : at + step], base_ids, b, k, metric, keep_self))

        rows = queries.select("id", "features")
        if shape.rows > cells.LEAST_ROWS:  # small files of many rows come as few partitions
            rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
        found = rows.mapInArrow(run, _PAIR)
    else:
        if in_cells:
            left, right = cells.pairs(queries, base, k + (not keep_self), metric, shape, block_rows)
        else:
            blocks, large = -(-shape.rows // block_rows), -(-shape.rows // max(block_rows, BLOCK_VALUES // (width + 1)))
            left = _packed(queries, block_rows, blocks, width).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(large - 1))))
            right = _packed(base, -(-shape.rows // large), large, width)  # large ones, as each gives k candidates a row
            cores = queries.sparkSession.sparkContext.defaultParallelism
            dealt = -(-8 * cores // large)  # parts of the queries, so that few large blocks keep all cores busy
            left = left.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(dealt)).cast("int"))
            right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))))
            parts = max(4 * cores, large // 8)
            left, right = left.repartition(parts, "other", "salt"), right.repartition(parts, "block", "salt")
        right = right.select(F.col("block").alias("other"), F.col("ids").alias("base_ids"), F.col("x").alias("base_x"), *([] if in_cells else ["salt"]))

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, x, base_ids, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    ids, x, base_ids, b = np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(-1, width), np.frombuffer(base_ids, np.int64), np.frombuffer(b).reshape(-1, width)
                    step = max(1, min(len(ids), (1 << 22) // max(1, len(base_ids))))
                    for at in range(0, len(ids), step):
                        yield _found(*nearest(ids[at : at + step], x[at : at + step], base_ids, b, k, metric, keep_self))

        found = left.join(right, "other" if in_cells else ["other", "salt"]).select("ids", "x", "base_ids", "base_x").mapInArrow(pairs, _PAIR)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "nbr")))
    return ranked.where(F.col("rank") <= k).select("id", "rank", "nbr", "distance")


def _collected(base: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    table = base.select("id", "features").toArrow()
    ids = table.column(0).to_numpy()
    order = np.argsort(ids)
    return ids[order], _matrix(table.column(1), width)[order] if table.num_rows else np.zeros((0, width))


def _packed(df: DataFrame, block_rows: int, blocks: int, width: int) -> DataFrame:
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), _matrix(table.column("features"), width)
        cuts = range(0, len(ids), 2 * block_rows)  # a block that hashing filled too much is split
        return pa.table({"block": pa.array([key[0].as_py()] * len(cuts), pa.int32()), "ids": [ids[c : c + 2 * block_rows].tobytes() for c in cuts], "x": [x[c : c + 2 * block_rows].tobytes() for c in cuts]}, schema=pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("x", pa.binary())]))

    return df.select("id", "features", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).groupBy("block").applyInArrow(pack, "block int, ids binary, x binary")


def core_distances(df: DataFrame, k: int, metric: Metric, shape: Shape, block_rows: int = 1024) -> DataFrame:
    """(id, core): distance to the k-th other point, or to the last if there are fewer."""
    k = min(k, shape.rows - 1)
    return knn(df, df, k, metric, shape, block_rows=block_rows).where(F.col("rank") == k).select("id", F.col("distance").alias("core"))


def prediction_core_distances(df: DataFrame, k: int, metric: Metric, shape: Shape, block_rows: int = 1024) -> DataFrame:
    """(id, core): the k-th smallest distance where the point itself counts."""
    k = min(max(k, 1), shape.rows)
    return knn(df, df, k, metric, shape, keep_self=True, block_rows=block_rows).where(F.col("rank") == k).select("id", F.col("distance").alias("core"))


def graph_core_distances(edges: DataFrame, k: int) -> DataFrame:
    """(id, core, stored): the k-th smallest stored edge of each vertex that has edges; null where there are fewer."""
    own = edges.where("src <> dst").select(F.col("src").alias("id"), "distance")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance")))
    return ranked.groupBy("id").agg(F.min(F.when(F.col("rank") == k, F.col("distance"))).alias("core"), F.count("*").alias("stored"))


def reachability(distance: Column, core_a: Column, core_b: Column, alpha: float = 1.0) -> Column:
    """The largest of the distance, divided by alpha, and both core distances."""
    return F.greatest(distance / alpha if alpha != 1 else distance, core_a, core_b)


_PACKED = pa.schema([("width", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("core", pa.binary())])
_REACH = "a long, b long, distance double, reach double"
#: Rows of a block whose pairs with another block's are written at once.
PAIRED_ROWS = 512


def mutual_reachability(df: DataFrame, core: DataFrame, metric: Metric, alpha: float = 1.0) -> DataFrame:
    """(a, b, distance, reach) of all pairs a < b: a report over a chosen set of rows; fits never make it.

    Pairs come block by block, near vectors in a block, so that what repeats stands together. The blocks are sent to
    all tasks, or met partition by partition where they are large: written out for each pair of blocks, they would fill the disk.
    """
    spark = df.sparkSession
    parts = 2 * spark.sparkContext.defaultParallelism
    points = df.join(core, "id").select("id", "features", "core").repartitionByRange(parts, "features", "core", "id").sortWithinPartitions("features", "core", "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRED_ROWS):
                part = batch.slice(at, PAIRED_ROWS)
                widths = np.unique(pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False))
                if len(widths) != 1:
                    raise InvalidShape("vectors differ in length")
                row = [int(widths[0]), *(v.to_numpy(zero_copy_only=False).tobytes() for v in (part.column(0), part.column(1).flatten(), part.column(2)))]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PACKED, strict=True)], schema=_PACKED)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _reached(row[: len(_PACKED)], row[len(_PACKED) :], metric, alpha)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                first, off = divmod(k, turns)
                if 2 * off == len(held) and first >= off:
                    continue  # met from the other side
                one, two = held[first], held[(first + off) % len(held)]
                yield from _reached(one, two, metric, alpha)
                if off:
                    yield from _reached(two, one, metric, alpha)

    blocks = stored(points.mapInArrow(pack, "width int, ids binary, x binary, core binary"))
    if (blocks.agg(F.sum(F.length("ids") + F.length("x") + F.length("core"))).first()[0] or 0) <= BROADCAST_BYTES:
        sent = spark.sparkContext.broadcast([tuple(r) for r in blocks.collect()])
        blocks, turns = len(sent.value), len(sent.value) // 2 + 1  # each block meets itself and half of those after it, in a circle
        return spark.range(0, blocks * turns, 1, max(1, min(blocks * turns, 4 * parts))).mapInArrow(dealt, _REACH)
    other = blocks.select(*(F.col(c).alias(f"{c}2") for c in blocks.columns))
    return blocks.repartition(parts).crossJoin(other.repartition(parts)).mapInArrow(met, _REACH)


def _reached(one: tuple, two: tuple, metric: Metric, alpha: float) -> Iterator[pa.RecordBatch]:
    """The pairs a < b of an a of one block and a b of another; where vectors repeat, those of equal vectors stand together."""
    (width, *packed), (width2, *packed2) = one, two
    if width != width2:
        raise InvalidShape("vectors differ in length")
    (ids, x, core), (ids2, y, core2) = ((np.frombuffer(v[0], np.int64), np.frombuffer(v[1]).reshape(-1, width), np.frombuffer(v[2])) for v in (packed, packed2))
    a, b = np.nonzero(ids[:, None] < ids2[None, :])
    if not len(a):
        return
    d = metric.kernel(x, y)[a, b]
    kind, kind2 = _kinds(x, core), _kinds(y, core2)
    kinds = (int(kind[-1]) + 1) * (int(kind2[-1]) + 1)
    if 8 * kinds <= min(len(ids) * len(ids2), 8 << 16):
        order = np.argsort((kind[a] * (kind2[-1] + 1) + kind2[b]).astype(np.uint16), kind="stable")
        a, b, d = a[order], b[order], d[order]
    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[a], ids2[b], d, np.maximum(d / alpha, np.maximum(core[a], core2[b])))], names=["a", "b", "distance", "reach"])


def _kinds(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Numbers of sorted rows from 0, one for all that are alike."""
    return np.cumsum(np.concatenate([[False], (x[1:] != x[:-1]).any(axis=1) | (core[1:] != core[:-1])]))
