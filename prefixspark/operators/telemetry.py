"""Counters, rates, hit rate, the bounded ring and the log pump over event tables."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_name
from .running import row_before, sum_before

# The ring's capacity, the pump's batch and lines, and the kinds that it leaves out.
RING_CAPACITY, PUMP_BATCH, PUMP_LINES = 4096, 64, 6
QUIET = ("CasContention", "TreeHit")
LEAST_SAMPLE_MS = 100


def counters(events: DataFrame, kind: str = "kind", kinds: list[str] | None = None) -> DataFrame:
    """One row with a count for each of ``kinds``, or a row for each kind found."""
    if kinds is None:
        return events.groupBy(kind).agg(F.count("*").alias("n"))
    return events.agg(*(F.count_if(F.col(kind) == k).alias(k) for k in kinds))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.try_divide(hits, hits + misses), F.lit(0.0))


def rates(samples: DataFrame, counter: str, ts: str = "ts", by: str | None = None) -> DataFrame:
    """``samples`` of a rising counter with ``rate`` a second since the sample before; samples closer than 100 ms have none."""
    micros, before = free_name(samples, "micros"), free_name(samples, "before")
    seen = row_before(samples.withColumn(micros, F.unix_micros(F.col(ts).cast("timestamp"))), [micros, counter], by, micros, before)
    gap = (F.col(micros) - F.col(before)[micros]) / 1e6
    rise = F.greatest(F.col(counter) - F.col(before)[counter], F.lit(0))
    return seen.withColumn("rate", F.when(gap >= LEAST_SAMPLE_MS / 1000, rise / gap)).drop(micros, before)


def rates_per_hour(events: DataFrame, kind: str = "event_type", ts: str = "ts") -> DataFrame:
    """(hour, kind, n, rate a second)."""
    return events.groupBy(F.date_trunc("hour", ts).alias("hour"), kind).agg(F.count("*").alias("n")).withColumn("rate", F.col("n") / 3600)


def ring(events: DataFrame, interval: str, order: str, capacity: int = RING_CAPACITY) -> DataFrame:
    """``events`` with ``kept``: between two drains a full ring drops what comes. ``interval`` names the drain."""
    return sum_before(events, F.lit(1), interval, order, "kept").withColumn("kept", F.col("kept") < capacity)


def ring_replay(ops: DataFrame, capacity: int = RING_CAPACITY) -> DataFrame:
    """What each operation of a collector's ring gives: ops are (ring, seq, op, word) with op "push", "pop" or "drain". Returns (ring,
    seq, op, kept, words): whether a push found room, the oldest word that a pop takes, all words that a drain takes.

    A full ring drops what is pushed. Sequential by ring, so each is one group.
    """

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        held: deque[int] = deque()
        kept, words = [], []
        pdf = pdf.sort_values("seq")
        for op, word in pdf[["op", "word"]].itertuples(index=False):
            room = len(held) < capacity
            taken = [] if op == "push" else [held.popleft() for _ in range(len(held) if op == "drain" else min(1, len(held)))]
            if op == "push" and room:
                held.append(int(word))
            kept.append(room if op == "push" else None)
            words.append(taken)
        return pdf[["ring", "seq", "op"]].assign(kept=pd.array(kept, "boolean"), words=words)

    return ops.groupBy("ring").applyInPandas(replay, "ring BIGINT, seq BIGINT, op STRING, kept BOOLEAN, words ARRAY<BIGINT>")


def pump(events: DataFrame, order: str, kind: str = "kind") -> DataFrame:
    """The last six lines of the first 64 events, quiet kinds left out. Both limits are the feature."""
    batch = events.orderBy(order).limit(PUMP_BATCH)
    return batch.where(~F.col(kind).isin(*QUIET)).orderBy(F.desc(order)).limit(PUMP_LINES)
