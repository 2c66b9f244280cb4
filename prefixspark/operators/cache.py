"""Prefix cache: longest stored token prefix, and second-chance (clock) eviction.

Matching is by stored prefix, so a slot that is used again can't answer for its earlier owner.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CacheCapacityExceeded, InvalidParameter, require
from ..functions.names import free_name

# Least capacity, grid cell, and the slot class of the cache (slot bytes, slots in a chunk).
LEAST_CAPACITY, CELL, SLOT, CHUNK_SLOTS = 4096, 8, 48, 83


def encode_key(tokens: Column) -> Column:
    """The tokens as 32-bit little-endian numbers, joined."""
    digits = lambda t: F.lpad(F.hex(t), 8, "0")
    swapped = F.transform(tokens, lambda t: F.concat(*(F.substring(digits(t), i, 2) for i in (7, 5, 3, 1))))
    return F.unhex(F.array_join(swapped, ""))


def latest(inserts: DataFrame) -> DataFrame:
    """(tokens, kv_offset): each prefix's last insert by ``seq``."""
    return inserts.groupBy("tokens").agg(F.max_by("kv_offset", "seq").alias("kv_offset"))


def match_prefix(cached: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries`` (query_id, tokens) with ``token_len`` and ``kv_offset`` of the longest cached prefix, nulls if none is.

    The cached lengths cut each query into candidates that meet the cache by hash and are compared in full.
    """
    lengths = cached.agg(F.coalesce(F.collect_set(F.size("tokens")), F.array().cast("array<int>")).alias("lengths"))  # one row
    asked = queries.select(F.col("tokens").alias("q")).dropna().distinct()
    cut = asked.crossJoin(F.broadcast(lengths)).select("q", F.explode(F.filter("lengths", lambda k: (k > 0) & (k <= F.size("q")))).alias("k"))
    cut = cut.select("q", "k", F.slice("q", F.lit(1), F.col("k")).alias("p")).withColumn("h", F.xxhash64("p"))
    stored = cached.select("tokens", "kv_offset").withColumn("h", F.xxhash64("tokens"))
    best = cut.join(stored, "h").where("p = tokens").groupBy("q").agg(F.max(F.struct("k", "kv_offset")).alias("best"))
    asked_for, longest = free_name(queries, "q"), free_name(queries, "best")
    best = best.select(F.col("q").alias(asked_for), F.col("best").alias(longest))
    found = queries.drop("kv_offset").join(best, F.col("tokens") == F.col(asked_for), "left")
    return found.withColumn("token_len", F.col(longest)["k"]).withColumn("kv_offset", F.col(longest)["kv_offset"]).drop(asked_for, longest)


def clock_batch(events: DataFrame, slot: str = "slot") -> DataFrame:
    """When each slot's content goes: events are (slot, seq, kind) with kind "insert", "touch" or "pass".

    A pass after an insert first only lowers its mark. From then on the content goes at the first pass with no touch since the
    pass before. Returns (slot, inserted, evicted): ``evicted`` is null for what stays.
    """
    by = Window.partitionBy(slot).orderBy("seq")
    life = events.withColumn("inserted", F.last(F.when(F.col("kind") == "insert", F.col("seq")), ignorenulls=True).over(by)).where("inserted IS NOT NULL")
    own = Window.partitionBy(slot, "inserted").orderBy("seq")
    passes = F.sum(F.when(F.col("kind") == "pass", 1).otherwise(0)).over(own)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    touched = F.last(F.when(F.col("kind") != "pass", F.col("seq")), ignorenulls=True).over(before)
    last_pass = F.last(F.when(F.col("kind") == "pass", F.col("seq")), ignorenulls=True).over(before)
    marked = life.withColumns({"_passes": passes, "_touched": touched, "_last_pass": last_pass})
    goes = (F.col("kind") == "pass") & (F.col("_passes") > 1) & (F.col("_touched") < F.col("_last_pass"))
    return marked.groupBy(slot, "inserted").agg(F.min(F.when(goes, F.col("seq"))).alias("evicted"))


@dataclass
class ClockCache:
    """One cache's state machine, for ordered replay and for streams."""

    capacity: int
    hand: int = 0
    chunks: int = 0
    free: list[int] = field(default_factory=list)
    live: dict[int, list] = field(default_factory=dict)  # grid cell: [tokens, kv_offset, mark]
    cell_of: dict[tuple[int, ...], int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        require(self.capacity >= LEAST_CAPACITY and self.capacity % CELL == 0, "capacity must be 4096 or more, by eights")

    @property
    def grid(self) -> int:
        return self.capacity // CELL

    def _slot(self) -> int | None:
        if not self.free and (self.chunks + 1) * SLOT * CHUNK_SLOTS <= self.capacity:
            base = self.chunks * SLOT * CHUNK_SLOTS
            self.free = [(base + i * SLOT) // CELL for i in range(CHUNK_SLOTS)]
            self.chunks += 1
        return self.free.pop() if self.free else None

    def insert(self, tokens: list[int], kv_offset: int) -> None:
        """Two whole sweeps make room; if no slot is free after them, the cache is full."""
        require(bool(tokens) and kv_offset != 0, "tokens and offset must not be empty")
        cell = self._slot()
        for _ in range(2):
            if cell is None:
                self.evict_step(self.grid - self.hand)
                self.evict_step(self.grid)
                cell = self._slot()
        if cell is None:
            raise CacheCapacityExceeded("no slot could be freed")
        key = tuple(tokens)
        self.live[cell] = [key, kv_offset, 1]
        self.cell_of[key] = cell

    def match(self, tokens: list[int]) -> tuple[int, int] | None:
        """(token_len, kv_offset) of the longest live prefix; its mark is set."""
        for n in range(len(tokens), 0, -1):
            if (cell := self.cell_of.get(tuple(tokens[:n]))) is not None:
                entry = self.live[cell]
                entry[2] |= 1
                return n, entry[1]
        return None

    def evict_step(self, steps: int) -> int:
        """Look at up to ``steps`` cells from the hand, not past the end; what has no mark goes, others lose one."""
        start = self.hand % self.grid
        end, gone = min(start + steps, self.grid), 0
        for cell in sorted(c for c in self.live if start <= c < end):
            entry = self.live[cell]
            if entry[2]:
                entry[2] -= 1
                continue
            del self.live[cell]
            if self.cell_of.get(entry[0]) == cell:
                del self.cell_of[entry[0]]
            self.free.append(cell)
            gone += 1
        self.hand = end % self.grid
        return gone

    def apply(self, op: str, tokens: list[int] | None, kv_offset: int | None, steps: int | None) -> tuple[int | None, int | None, int | None]:
        """(token_len, kv_offset, evicted) of one operation: "insert", "match" or "sweep"."""
        if op == "insert":
            self.insert(list(tokens or ()), int(kv_offset or 0))
            return None, None, None
        if op == "match":
            found = self.match(list(tokens or ()))
            return (*found, None) if found else (None, None, None)
        if op == "sweep":
            return None, None, self.evict_step(int(steps or 0))
        raise InvalidParameter(f"unknown operation {op}")


def _number(v) -> int | None:
    return None if v is None or v != v else int(v)


def replay_rows(cache: ClockCache, pdf: pd.DataFrame) -> Iterator[tuple]:
    """(seq, op, token_len, kv_offset, evicted) of a cache's operations in order."""
    for seq, op, tokens, kv_offset, steps in pdf.sort_values("seq")[["seq", "op", "tokens", "kv_offset", "steps"]].itertuples(index=False):
        yield (int(seq), op, *cache.apply(op, None if tokens is None else [int(t) for t in tokens], _number(kv_offset), _number(steps)))


def replay(ops: DataFrame, capacity: int, cache: str = "cache_id") -> DataFrame:
    """Apply each cache's operations in order. One cache is one hand, and so one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(replay_rows(ClockCache(capacity), pdf), columns=["seq", "op", "token_len", "kv_offset", "evicted"])
        out.insert(0, cache, pdf[cache].iloc[0])
        return out.astype({"token_len": "Int64", "kv_offset": "Int64", "evicted": "Int64"})

    return ops.groupBy(cache).applyInPandas(run, f"{cache} BIGINT, seq BIGINT, op STRING, token_len BIGINT, kv_offset BIGINT, evicted BIGINT")
