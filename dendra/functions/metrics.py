"""Distances: a column expression for plans, and a blocked numpy kernel for joins."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidConfig


@dataclass(frozen=True)
class Metric:
    """A named distance. ``column`` is None where only the kernel is given (custom functions)."""

    name: str
    kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]
    column: Callable[[Column, Column], Column] | None = None
    indexes: tuple[str, ...] = ()

    def distance(self, a: Column, b: Column) -> Column:
        """The distance of two array columns; arrays of unequal length raise, as zip_with would pad them."""
        if self.column is None:
            raise InvalidConfig(f"{self.name} has no column expression")
        return F.when(F.size(a) == F.size(b), self.column(a, b)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))

    def squared(self, a: Column, b: Column) -> Column:
        if self.name == "euclidean":
            return SQUARED_EUCLIDEAN.distance(a, b)
        d = self.distance(a, b)
        return d * d


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _gaps(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def _scaled_euclid(a: Column, b: Column) -> Column:
    gaps = _gaps(a, b)
    plain = F.sqrt(_total(F.transform(gaps, lambda g: g * g)))
    most = F.array_max(gaps)
    scaled = most * F.sqrt(_total(F.transform(gaps, lambda g: (g / most) * (g / most))))
    return F.when(F.size(a) == 0, F.lit(0.0)).when((most > 0) & ((most > 1e150) | (most < 1e-150)), scaled).otherwise(plain)


def _each(a: np.ndarray, b: np.ndarray, add: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Folds the coordinates in order, so that sums are the same for a pair whichever block holds it."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out = add(out, a[:, j, None], b[None, :, j])
    return out


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        gap *= gap
        out += gap
    return out


def _euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", under="ignore"):
        d = np.sqrt(_sq(a, b))
    if d.size and d.min() > 1e-140 and d.max() < 1e150:
        return d
    odd = ~((d > 1e-140) & (d < 1e150))
    if odd.any():
        i, j = np.nonzero(odd)
        d[i, j] = _scaled(a[i], b[j])
    return d


def _scaled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows beside each other, whose squares would overflow or vanish."""
    gap = np.abs(a - b)
    most = gap.max(axis=1) if gap.shape[1] else np.zeros(len(gap))
    unit = np.divide(gap, most[:, None], out=np.zeros_like(gap), where=most[:, None] > 0)
    return most * np.sqrt((unit * unit).sum(axis=1))


#: Columns from which a product of matrices tells sooner than folding which pairs are near.
PRODUCT_COLUMNS = 16


def by_products(metric: Metric, columns: int) -> bool:
    return metric.name in ("euclidean", "sqeuclidean") and columns >= PRODUCT_COLUMNS


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Squared distances by a product of matrices, and for each row what they may be off from those that ``paired`` folds; None where squares may overflow."""
    with np.errstate(over="ignore"):
        x, y = (a * a).sum(axis=1), (b * b).sum(axis=1)
        most = x + y.max(initial=0.0)
    if not (most < 1e290).all():
        return None
    off = 16 * (a.shape[1] + 16) * np.finfo(float).eps * most + 1e-290
    left, right = np.column_stack([-2 * a, x, np.ones(len(a))]), np.column_stack([b, np.ones(len(b)), y])
    return left @ right.T, off


def paired(metric: Metric, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows beside each other under a metric of ``by_products``: the values of its kernel."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore", under="ignore"):
        for j in range(a.shape[1]):
            gap = a[:, j] - b[:, j]
            gap *= gap
            out += gap
    if metric.name == "sqeuclidean":
        return out
    out = np.sqrt(out)
    odd = np.flatnonzero(~((out > 1e-140) & (out < 1e150)))
    if len(odd):
        out[odd] = _scaled(a[odd], b[odd])
    return out


def _canberra_term(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.abs(x) + np.abs(y)
    return s + np.divide(np.abs(x - y), total, out=np.zeros(np.broadcast(x, y).shape), where=total != 0)


def _braycurtis(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    up = _each(a, b, lambda s, x, y: s + np.abs(x - y))
    low = _each(a, b, lambda s, x, y: s + np.abs(x + y))
    return np.divide(up, low, out=np.zeros_like(up), where=low != 0)


EUCLIDEAN = Metric("euclidean", _euclid, _scaled_euclid, ("kdtree", "balltree"))
SQUARED_EUCLIDEAN = Metric("sqeuclidean", _sq, lambda a, b: _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
MANHATTAN = Metric("manhattan", lambda a, b: _each(a, b, lambda s, x, y: s + np.abs(x - y)), lambda a, b: _total(_gaps(a, b)), ("kdtree", "balltree"))
CHEBYSHEV = Metric("chebyshev", lambda a, b: _each(a, b, lambda s, x, y: np.maximum(s, np.abs(x - y))), lambda a, b: F.coalesce(F.array_max(_gaps(a, b)), F.lit(0.0)), ("kdtree", "balltree"))
CANBERRA = Metric(
    "canberra",
    lambda a, b: _each(a, b, _canberra_term),
    lambda a, b: _total(F.zip_with(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) != 0, F.abs(x - y) / F.nullif(F.abs(x) + F.abs(y), F.lit(0.0))).otherwise(0.0))),
    ("balltree",),
)
BRAYCURTIS = Metric(
    "braycurtis",
    _braycurtis,
    lambda a, b: F.coalesce(_total(_gaps(a, b)) / F.nullif(_total(F.zip_with(a, b, lambda x, y: F.abs(x + y))), F.lit(0.0)), F.lit(0.0)),
    ("balltree",),
)


def minkowski(p: float) -> Metric:
    """Exponent 1 is the Manhattan distance and 2 the Euclidean, but under a name of its own."""
    if not (math.isfinite(p) and p >= 1):
        raise InvalidConfig(f"Minkowski exponent {p} has to be finite and 1 at least")
    name = f"minkowski({p:g})"
    if p in (1, 2):
        base = MANHATTAN if p == 1 else EUCLIDEAN
        return Metric(name, base.kernel, base.column, base.indexes)

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = CHEBYSHEV.kernel(a, b)
        unit = np.where(most > 0, most, 1)
        return most * _each(a, b, lambda s, x, y: s + (np.abs(x - y) / unit) ** p) ** (1 / p)

    def column(a: Column, b: Column) -> Column:
        gaps = _gaps(a, b)
        most = F.coalesce(F.array_max(gaps), F.lit(0.0))
        return F.when(most == 0, F.lit(0.0)).otherwise(most * F.pow(_total(F.transform(gaps, lambda g: F.pow(g / F.nullif(most, F.lit(0.0)), F.lit(p)))), F.lit(1 / p)))

    return Metric(name, kernel, column, ("kdtree", "balltree"))


def custom(distance: Callable[[np.ndarray, np.ndarray], float], name: str = "custom") -> Metric:
    """A distance of two vectors given as a Python function; evaluated inside the blocked kernel."""

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.array([[distance(x, y) for y in b] for x in a], float).reshape(len(a), len(b))

    return Metric(name, kernel)


BUILTIN = {m.name: m for m in (EUCLIDEAN, SQUARED_EUCLIDEAN, MANHATTAN, CHEBYSHEV, CANBERRA, BRAYCURTIS)}


def metric_of(value: Metric | str | Callable | None) -> Metric:
    if value is None:
        return EUCLIDEAN
    if isinstance(value, Metric):
        return value
    if callable(value):
        return custom(value)
    if value in BUILTIN:
        return BUILTIN[value]
    if value.startswith("minkowski(") and value.endswith(")"):
        return minkowski(float(value[10:-1]))
    raise InvalidConfig(f"unknown metric {value!r}")


def valid_spatial_indexes(value: Metric | str | None) -> tuple[str, ...]:
    return metric_of(value).indexes


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def density(distance: Column) -> Column:
    """1 / distance, infinite at zero."""
    return F.when(distance > 0, 1 / F.nullif(distance, F.lit(0.0))).otherwise(F.lit(float("inf")))
