"""Configurations. None stands for the default; validation names the field at fault."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from ..errors import InvalidConfig, TooFewPoints
from ..functions.metrics import Metric, metric_of

EOM, LEAF = "eom", "leaf"
AUTO, KDTREE, BRUTE, APPROXIMATE, REFERENCE = "auto", "kdtree", "bruteforce", "approximate", "reference"
FULL, CORE = "full", "core"


def _finite(value: float, name: str, least: float = 0.0, most: float = math.inf) -> None:
    if math.isnan(value) or math.isinf(value) or not least <= value <= most:
        raise InvalidConfig(f"{name} is {value}")


@dataclass(frozen=True)
class ExtractionConfig:
    """How flat clusters are chosen from a condensed tree."""

    method: str = EOM
    allow_single_cluster: bool = False
    max_cluster_size: int = 0
    epsilon: float = 0.0
    persistence: float = 0.0

    def validated(self) -> ExtractionConfig:
        if self.method not in (EOM, LEAF):
            raise InvalidConfig(f"method is {self.method!r}")
        if self.max_cluster_size < 0:
            raise InvalidConfig(f"max_cluster_size is {self.max_cluster_size}")
        _finite(self.epsilon, "epsilon")
        _finite(self.persistence, "persistence", most=1.0)
        return self


@dataclass(frozen=True)
class Config:
    min_cluster_size: int | None = None
    min_samples: int | None = None
    metric: Metric | str | Callable | None = None
    alpha: float = 1.0
    extraction: ExtractionConfig = ExtractionConfig()
    algorithm: str = AUTO
    workers: int = 0
    prediction_data: bool = False
    branch_data: bool = False
    approximate_backend: Any = None
    approximate_candidates: int = 0
    #: Rows up to which one task holds all vectors and Prim's order decides ties; beyond, blocks are joined and ties go by id.
    prim_rows: int = 20_000
    block_rows: int = 1024

    def validated(self, rows: int | None = None) -> Config:
        size = 5 if self.min_cluster_size is None else self.min_cluster_size
        samples = size if self.min_samples is None else self.min_samples
        if size < 2:
            raise InvalidConfig(f"min_cluster_size is {size}")
        if samples < 1:
            raise InvalidConfig(f"min_samples is {samples}")
        _finite(self.alpha, "alpha")
        if self.alpha <= 0:
            raise InvalidConfig(f"alpha is {self.alpha}")
        if self.workers < 0:
            raise InvalidConfig(f"workers is {self.workers}")
        if self.algorithm not in (AUTO, KDTREE, BRUTE, APPROXIMATE, REFERENCE):
            raise InvalidConfig(f"algorithm is {self.algorithm!r}")
        metric = metric_of(self.metric)
        if self.algorithm == KDTREE and metric.name != "euclidean":
            raise InvalidConfig("kdtree is for the Euclidean metric")
        if rows is not None and rows < 2:
            raise TooFewPoints(f"{rows} rows")
        return replace(self, min_cluster_size=size, min_samples=samples, metric=metric, extraction=self.extraction.validated())


@dataclass(frozen=True)
class BranchConfig:
    """min_cluster_size and method are inherited from the fit where None; nothing else is."""

    graph: str = FULL
    min_cluster_size: int | None = None
    method: str | None = None
    allow_single_cluster: bool = False
    max_cluster_size: int = 0
    epsilon: float = 0.0
    persistence: float = 0.0
    label_sides: bool = False

    def validated(self, fitted: Config) -> BranchConfig:
        if self.graph not in (FULL, CORE):
            raise InvalidConfig(f"graph is {self.graph!r}")
        size = fitted.min_cluster_size if self.min_cluster_size is None else self.min_cluster_size
        if size < 2:
            raise InvalidConfig(f"min_cluster_size is {size}")
        method = self.method or fitted.extraction.method
        ExtractionConfig(method, self.allow_single_cluster, self.max_cluster_size, self.epsilon, self.persistence).validated()
        return replace(self, min_cluster_size=size, method=method)

    @property
    def extraction(self) -> ExtractionConfig:
        return ExtractionConfig(self.method, self.allow_single_cluster, self.max_cluster_size, self.epsilon, self.persistence)


@dataclass(frozen=True)
class RobustConfig:
    cut: float
    k: int = 5
    gamma: int = 5
    alpha: float = math.sqrt(2)
    metric: Metric | str | Callable | None = None

    def validated(self) -> RobustConfig:
        if self.k < 1 or self.gamma < 1:
            raise InvalidConfig("k and gamma have to be 1 at least")
        _finite(self.cut, "cut")
        _finite(self.alpha, "alpha", least=1.0)
        return replace(self, metric=metric_of(self.metric))


def contiguous(labels: Sequence[int]) -> None:
    """Labels given from outside: -1 or more, without a gap."""
    seen = {x for x in labels if x >= 0}
    if any(x < -1 for x in labels):
        raise InvalidConfig("a cluster label is less than -1")
    if seen and max(seen) + 1 != len(seen):
        raise InvalidConfig("cluster labels have to be contiguous")
