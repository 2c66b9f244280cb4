"""Column-wise construction of a collection's Burrows-Wheeler transform with common prefixes, in its positional form.

The documents of a collection are laid into columns so that equal strings that matter lie in equal columns. From the last
column to the first, each round inserts one symbol of every document in front of its suffix: the order of all suffixes
that start in the column, and the common prefix of each with the one before it, follow from those of the round before by
one stable distribution by symbol. A round reads the last column's files (order, common prefixes) and one column of text
from front to back, and writes the new ones: ``sequence`` files of fixed width, here arrays of a bounded bucket.

Each round costs the documents, not the suffixes so far, so the whole costs the symbols. The general form, whose rounds
merge into the transform of all earlier suffixes, costs symbols times rounds; documents that share no alignment need it.
"""

from __future__ import annotations

import numpy as np


def next_column(symbol: np.ndarray, block: np.ndarray, order: np.ndarray, prefix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """One round. ``symbol`` (by document, 0 for none) goes in front of the suffixes in ``order`` with common prefixes ``prefix``
    (0 at a group's first). Documents of a group stand together, in ``block``, throughout. Prefixes are counted up to ``most``."""
    s = symbol[order]
    o = np.argsort(s, kind="stable")
    o = o[np.argsort(block[o], kind="stable")]
    s = s[o]
    out = np.zeros(len(order), prefix.dtype)
    same = np.flatnonzero((s[1:] == s[:-1]) & (s[1:] > 0) & (block[1:] == block[:-1])) + 1
    lo, hi = o[same - 1] + 1, o[same]
    least = prefix[hi]
    apart = np.flatnonzero(lo < hi)
    if len(apart):
        edges = np.column_stack([lo[apart], hi[apart] + 1]).ravel()
        least[apart] = np.minimum.reduceat(np.append(prefix, prefix[:1]), edges)[::2]
    out[same] = np.minimum(least + 1, most)
    return order[o], out


def repeated_windows(texts: list[bytes], groups: np.ndarray, shifts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, the places at which a string of ``length`` bytes starts that a text of its group has in the same columns.
    ``shifts`` are the columns of the texts' first bytes."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    shifts = np.asarray(shifts, np.int64)
    width = int((shifts + sizes).max()) if n else 0
    columns = np.zeros((n, width), np.uint16)  # byte + 1; 0 where a text has no symbol
    for i, t in enumerate(texts):
        columns[i, shifts[i] : shifts[i] + sizes[i]] = np.frombuffer(t, np.uint8)
        columns[i, shifts[i] : shifts[i] + sizes[i]] += 1
    columns = np.ascontiguousarray(columns.T)
    _, block = np.unique(np.asarray(groups), return_inverse=True)
    order = np.argsort(block, kind="stable")
    block = block[order].astype(np.uint16 if n < 1 << 16 else np.int64)
    prefix = np.zeros(n, np.int32)
    last = max(width - length, -1)
    found = np.zeros((last + 1, n), bool)
    for k in range(width - 1, -1, -1):
        order, prefix = next_column(columns[k], block, order, prefix, length)
        if k <= last:
            hit = prefix >= length
            hit[:-1] |= hit[1:]
            found[k, order] = hit
    return [np.flatnonzero(f) - s for f, s in zip(np.ascontiguousarray(found.T), shifts, strict=True)]
