"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming lookup, exact verification.

Texts are lower-cased (A-Z), split at white space and cut into shingles of five words. For an item of n shingles
the windows are n shingles long, at every word. A window can reach the similarity t only if at least
2nt / (1 + t) of its shingles belong to the benchmark, so others are passed over without loss. The window's
SimHash is looked up in four blocks of 16 bits of the items of that size. With a radius of 4r + a, two fingerprints within it
differ by r or fewer bits in one of the first a + 1 blocks, or by fewer than r in another, so all values that near are probed
and none is missed; of unrelated fingerprints a fifth meets at radius 20. The candidate's weighted similarity (sum of least over
sum of greatest shingle counts) is then computed exactly. An item shorter than a shingle is one shingle of its own length.

A text of fewer shingles than the item is one window as a whole. It is compared exactly, without fingerprints, with all
items that share shingles with it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .simhash_dedup import BITS, bit_majority

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SHINGLE = 5
#: Items that are sent to the executors at once; more are searched in further blocks.
ITEM_BLOCK = 20_000
_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word shingles, from word hashes (uint64)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = h * _MULTIPLY + words[i : len(words) - n + 1 + i]
        h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str, seen: dict) -> np.ndarray:
    words = text.encode().translate(_LOWER).split()
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def weighted_similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / (a.total() + b.total() - shared)


BLOCKS, WIDTH = 4, 16
#: Windows that are probed at once.
PROBED = 64


@lru_cache
def near_values(most: int) -> np.ndarray:
    """All 16-bit numbers of at most ``most`` set bits: what is added to a block's value to probe its neighbours."""
    return np.array([sum(1 << i for i in bits) for k in range(most + 1) for bits in combinations(range(WIDTH), k)], np.uint16)


def block_radii(radius: int) -> list[int]:
    """How far each block is probed (-1: not at all)."""
    r, a = divmod(radius, BLOCKS)
    return [r if b <= a else r - 1 for b in range(BLOCKS)]


class Benchmark:
    """The items by shingle length and number of shingles, with the block index of each such class."""

    def __init__(self, items: list[tuple[int, str]], radius: int, similarity: float):
        self.radius, self.similarity, seen = radius, similarity, _Words()
        self.classes: dict[tuple[int, int], list[tuple[int, Counter, int]]] = defaultdict(list)
        owners: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            words = word_hashes(text or "", seen)
            if not len(words):
                continue
            k = min(SHINGLE, len(words))
            h = shingles(words, k)
            self.classes[k, len(h)].append((item_id, Counter(h.tolist()), bit_majority(h)))
            for x in h.tolist():
                owners[k][x].add((len(h), len(self.classes[k, len(h)]) - 1))
        self.fps = {c: np.array([fp for *_, fp in m], np.uint64) for c, m in self.classes.items()}
        self.index = {c: [self._block(fps, b) for b in range(BLOCKS)] for c, fps in self.fps.items()}
        self.sets = {}  # by shingle length: sorted hashes, sizes of the items that have them, a bit table of 2^20 places
        self.holders = {}  # by shingle length, for each of the sorted hashes: (size, place in its class) of the items that have it
        for k, of in owners.items():
            keys = np.array(sorted(of), np.uint64)
            table = np.zeros(1 << 20, bool)
            table[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.sets[k] = keys, [sorted({n for n, _ in of[x]}) for x in keys.tolist()], table
            self.holders[k] = [sorted(of[x]) for x in keys.tolist()]

    @staticmethod
    def _block(fps: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A block's values in order, the items that have them, and a bit for each of the 2^16 values: 8 KiB."""
        part = (fps >> np.uint64(WIDTH * b)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        held = np.zeros(1 << WIDTH, bool)
        held[part] = True
        return part[order], order, np.packbits(held, bitorder="little")

    def candidates(self, c: tuple[int, int], fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, items) that one block lets pass, block by block."""
        for b, (most, (part, order, held)) in enumerate(zip(block_radii(self.radius), self.index[c], strict=True)):
            if most < 0:
                continue
            masks = near_values(most)
            for i in range(0, len(fps), PROBED):
                probes = (fps[i : i + PROBED] >> np.uint64(WIDTH * b)).astype(np.uint16)[:, None] ^ masks
                w, m = np.nonzero((held[probes >> 3] >> (probes & 7).astype(np.uint8)) & 1)
                value = probes[w, m]
                lo, hi = np.searchsorted(part, value, "left"), np.searchsorted(part, value, "right")
                at = np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)
                yield np.repeat(w + i, hi - lo), order[at]

    def near(self, c: tuple[int, int], fps: np.ndarray) -> set[tuple[int, int]]:
        """(window, item) of all pairs within the radius."""
        out = set()
        for w, item in self.candidates(c, fps):
            on = np.bitwise_count(fps[w] ^ self.fps[c][item]) <= self.radius
            out.update(zip(w[on].tolist(), item[on].tolist(), strict=True))
        return out

    def whole(self, k: int, h: np.ndarray, places: list[int]) -> Iterator[tuple[int, int, float]]:
        """(size, place in its class, similarity) of the items of more shingles than the text, from all shingles ``h`` of the text
        and the places of those that the benchmark has."""
        mine, keys, shared = Counter(h.tolist()), self.sets[k][0], Counter()
        for p in places:
            x = int(keys[p])
            for n, i in self.holders[k][p]:
                if len(h) < n:
                    shared[n, i] += min(mine[x], self.classes[k, n][i][1][x])
        for (n, i), both in sorted(shared.items()):
            yield n, i, both / (len(h) + n - both)

    def matches(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item_id: (similarity, first word, words) of the best window, the first of equals."""
        best: dict[int, tuple[float, int, int]] = {}
        for k, (keys, sizes, table) in self.sets.items():
            h = shingles(words, k)
            if not len(h):
                continue
            maybe = np.flatnonzero(table[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            on = keys[place] == h[maybe]
            maybe, place = maybe[on], place[on]
            if not len(maybe):
                continue
            hit = np.zeros(len(h) + 1, np.int64)
            hit[maybe + 1] = 1
            hit = np.cumsum(hit)
            places = np.unique(place).tolist()
            # an item of one shingle more needs the fewest shared
            if len(maybe) >= math.ceil((2 * len(h) + 1) * self.similarity / (1 + self.similarity) - 1e-9):
                for n, i, s in self.whole(k, h, places):
                    item_id = self.classes[k, n][i][0]
                    if s >= self.similarity and (item_id not in best or s > best[item_id][0]):
                        best[item_id] = s, 0, len(words)
            for n in {s for p in places for s in sizes[p]}:
                if n > len(h):
                    continue
                least = math.ceil(2 * n * self.similarity / (1 + self.similarity) - 1e-9)
                starts = np.flatnonzero(hit[n:] - hit[:-n] >= least)
                if not len(starts):
                    continue
                for w, i in sorted(self.near((k, n), window_fingerprints(h, starts, n))):
                    item_id, weights, _ = self.classes[k, n][i]
                    a = int(starts[w])
                    s = weighted_similarity(Counter(h[a : a + n].tolist()), weights)
                    if s >= self.similarity and (item_id not in best or s > best[item_id][0]):
                        best[item_id] = s, a, n + k - 1
        return best


def window_fingerprints(h: np.ndarray, starts: np.ndarray, n: int, step: int = 4096) -> np.ndarray:
    """SimHash of the shingles [s, s + n) for each start, in runs of bounded memory."""
    out = []
    for i in range(0, len(starts), step):
        part = starts[i : i + step]
        runs = np.split(part, np.flatnonzero(np.diff(part) > n) + 1)
        for run in runs:
            lo = run[0]
            bits = np.unpackbits(np.ascontiguousarray(h[lo : run[-1] + n]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.concatenate([np.zeros((1, BITS), np.int64), np.cumsum(bits, axis=0, dtype=np.int64)])
            out.append(np.packbits(2 * (ones[run - lo + n] - ones[run - lo]) > n, axis=1, bitorder="little").view(np.uint64)[:, 0])
    return np.concatenate(out)


_SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def _search(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Words()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for item_id, (s, at, n) in sent.value.matches(word_hashes(text, seen)).items():
                    for column, value in zip(out, (doc_id, item_id, s, at, n), strict=True):
                        column.append(value)
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 2 else pa.int64()) for i, c in enumerate(out)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", radius: int = 20, similarity: float = 0.8) -> DataFrame:
    """A row for each (document, item) with a window of the similarity or more: doc_id, item_id, similarity, first_word,
    n_words of the best window. A text shorter than the item is one window.

    At a similarity of 0.8 two fingerprints differ in 10 of 64 bits, 3 more or less, so a radius of 20 misses one window in five
    thousand at the very bound.

    Null and empty texts match nothing, nor do items without words. Very long texts are searched whole. Documents that repeat give their rows each; of
    items that share an id the best window counts. Empty tables give an empty table. The items are the query set: they go
    out in blocks of ``ITEM_BLOCK``, each searched in all documents. Other columns are not read.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), text_of(item_text_col).alias("text"))
    n_blocks = -(-items.count() // ITEM_BLOCK)
    out = spark.createDataFrame([], _SCHEMA)
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).collect() if n_blocks > 1 else items.collect()
        sent = spark.sparkContext.broadcast(Benchmark([(r["item_id"], r["text"]) for r in block], radius, similarity))
        found = picked.mapInArrow(_search(sent), _SCHEMA)
        out = found if n_blocks == 1 else out.unionByName(found)
    return out
