"""Handles and status codes over the vector index and the prefix cache: fourteen functions that never raise.

Each returns (status, value). Status 0 is success, 1 to 12 are the error classes, 100 is a missing argument.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .errors import NULL_ARGUMENT, EngineError, InvalidParameter
from .operators.cache import ClockCache
from .operators.vector import IvfConfig, IvfIndex
from .sources.catalog import Catalog

VERSION = "0.1.0"
_handles: dict[int, IvfIndex | ClockCache] = {}
_numbers = itertools.count(1)


def _guarded(kind: type | None = None):
    """Turn errors into codes; with ``kind`` the first argument is a handle of that kind."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def call(*args):
            if any(a is None for a in args):
                return NULL_ARGUMENT, None
            if kind is not None:
                held = _handles.get(args[0])
                if not isinstance(held, kind):
                    return InvalidParameter.status, None
                args = (held, *args[1:])
            try:
                return 0, f(*args)
            except EngineError as e:
                return e.status, None

        return call

    return wrap


def _keep(thing: IvfIndex | ClockCache) -> int:
    handle = next(_numbers)
    _handles[handle] = thing
    return handle


@_guarded()
def version() -> str:
    return VERSION


@_guarded()
def index_create(spark: SparkSession, folder: str, dimension: int, n_centroids: int, sub_vectors: int, seed: int) -> int:
    return _keep(IvfIndex(spark, IvfConfig(dimension, n_centroids, sub_vectors, seed), Catalog(spark, folder)))


@_guarded()
def index_destroy(handle: int) -> None:
    _handles.pop(handle, None)


@_guarded(IvfIndex)
def index_train(index: IvfIndex, samples: DataFrame) -> int:
    return index.train(samples)


@_guarded(IvfIndex)
def index_insert(index: IvfIndex, vectors: DataFrame) -> None:
    index.insert(vectors)


@_guarded(IvfIndex)
def index_search(index: IvfIndex, queries: DataFrame, k: int) -> DataFrame:
    return index.search(queries, k)


@_guarded(IvfIndex)
def index_vector_count(index: IvfIndex) -> int:
    return index.vector_count()


@_guarded(IvfIndex)
def index_is_trained(index: IvfIndex) -> bool:
    return index.is_trained


@_guarded(IvfIndex)
def index_recluster(index: IvfIndex) -> int | None:
    return index.recluster()


@_guarded()
def kv_create(capacity: int) -> int:
    return _keep(ClockCache(capacity))


@_guarded()
def kv_destroy(handle: int) -> None:
    _handles.pop(handle, None)


@_guarded(ClockCache)
def kv_insert(cache: ClockCache, tokens: list[int], kv_offset: int) -> None:
    cache.insert(tokens, kv_offset)


@_guarded(ClockCache)
def kv_match(cache: ClockCache, tokens: list[int]) -> tuple[int, int] | None:
    return cache.match(tokens)


@_guarded(ClockCache)
def kv_evict(cache: ClockCache, steps: int) -> int:
    return cache.evict_step(steps)
