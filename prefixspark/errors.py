"""Error classes with their status codes, and eager parameter checks."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors; ``status`` is the public code."""

    status = 0


class ArenaBoundsExceeded(EngineError):
    status = 1


class ArenaCapacityExceeded(EngineError):
    status = 2


class AllocationFailed(EngineError):
    status = 3


class InvalidNodeType(EngineError):
    status = 4


class WalFrameMalformed(EngineError):
    status = 5


class WalFrameTooLarge(EngineError):
    status = 6


class UnknownPinnedPointer(EngineError):
    status = 7


class TreeInvariantViolation(EngineError):
    status = 8


class VectorDimensionMismatch(EngineError):
    status = 9


class InvalidParameter(EngineError):
    status = 10


class CacheCapacityExceeded(EngineError):
    status = 11


class GpuDriverUnavailable(EngineError):
    status = 12


#: Status of a missing (null) argument at the session surface.
NULL_ARGUMENT = 100


def require(ok: bool, what: str, error: type[EngineError] = InvalidParameter) -> None:
    if not ok:
        raise error(what)
