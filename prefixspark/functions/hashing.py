"""FNV-1a over bytes with wrap-around products, which ANSI arithmetic would reject: Arrow batches and NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# FNV-1a's offset basis and prime.
BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3


@F.pandas_udf(LongType())
def fnv1a56(keys: pd.Series) -> pd.Series:
    """The low 56 bits of each key's FNV-1a, one byte of all keys at a time."""
    n = keys.str.len().fillna(0).to_numpy(np.int64)
    width = int(n.max()) if len(n) else 0
    table = np.zeros((len(n), width), np.uint8)
    for i, k in enumerate(keys):
        table[i, : n[i]] = np.frombuffer(k or b"", np.uint8)
    h = np.full(len(n), BASIS, np.uint64)
    for j in range(width):
        h = np.where(j < n, (h ^ table[:, j]) * np.uint64(PRIME), h)
    return pd.Series((h & np.uint64((1 << 56) - 1)).astype(np.int64))
