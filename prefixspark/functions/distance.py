"""Squared Euclidean distance: a Column for pairs, NumPy kernels for Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_sq(a: Column, b: Column) -> Column:
    """In double; null where the lengths differ, 0 for empty vectors."""
    each = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.aggregate(each, F.lit(0.0), lambda s, x: s + x))


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of doubles."""
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def distances(rows: np.ndarray, points: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """All squared distances, by differences (no cancellation), in blocks of bounded memory."""
    out = np.empty((len(rows), len(points)))
    step = max(1, block // max(1, points.size))
    for i in range(0, len(rows), step):
        out[i : i + step] = ((rows[i : i + step, None, :] - points[None]) ** 2).sum(-1)
    return out


def closest(rows: np.ndarray, points: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """``distances(rows, points).argmin(1)``: by products first, then by differences where those can't tell two points apart."""
    out = np.empty(len(rows), int)
    norms, step = (points**2).sum(1), max(1, block // len(points))
    for i in range(0, len(rows), step):
        x = rows[i : i + step]
        score = x @ (-2 * points.T)
        score += norms
        best = score.argmin(1)
        at = np.arange(len(x))
        # products and norms are wrong by less than this, as sums of so many terms of this size
        slack = 1e-15 * (8 + 4 * points.shape[1]) * ((x**2).sum(1) + norms.max())
        least = score[at, best] + slack
        score[at, best] = np.inf
        close = np.flatnonzero(~(score.min(1) > least))
        best[close] = distances(x[close], points).argmin(1)
        out[i : i + step] = best
    return out
