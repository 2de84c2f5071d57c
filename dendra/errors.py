"""Errors by kind; messages say what was wrong."""


class DendraError(Exception):
    pass


class InvalidConfig(DendraError, ValueError):
    pass


class TooFewPoints(DendraError, ValueError):
    pass


class InvalidShape(DendraError, ValueError):
    pass


class NonFinite(DendraError, ValueError):
    pass


class InvalidDistance(DendraError, ValueError):
    pass


class InvalidPrecomputed(DendraError, ValueError):
    pass


class InvalidSparse(DendraError, ValueError):
    pass


class Disconnected(DendraError, ValueError):
    pass


class InsufficientNeighbors(DendraError, ValueError):
    pass


class PredictionDataMissing(DendraError):
    pass


class PredictionUnsupported(DendraError):
    pass


class BranchDataMissing(DendraError):
    pass


class BranchUnsupported(DendraError):
    pass
