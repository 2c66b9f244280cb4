"""Structured Streaming forms: hourly rates with late data, vector appends by micro-batch, and a cache's clock as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cache import ClockCache, replay_rows
from ..operators.vector import postings


def hourly_rates(events: DataFrame, watermark: str = "10 minutes", kind: str = "event_type") -> DataFrame:
    """(window, kind, n) of a stream of events; what is later than the watermark is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.groupBy(F.window("ts", "1 hour"), kind).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes", key: str = "user_id") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))


def append_vectors(vectors: DataFrame, index, checkpoint: str):
    """Append a stream of (id, vec) to an index's journal; ids that the journal holds are skipped, so a repeated batch changes
    nothing."""

    def batch(df: DataFrame, _: int) -> None:
        fresh = df.dropDuplicates(["id"]).join(index.catalog.journal().select("id"), "id", "left_anti")
        rows = index.catalog.stage(fresh.select(F.col("id").cast("bigint"), F.col("vec").cast("array<float>").alias("vec")))
        index.catalog.append_journal(rows)
        index.catalog.append_postings(postings(rows, index.catalog.model(index.catalog.current())))
        index.catalog.drop_stage()

    return vectors.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clock(ops: DataFrame, capacity: int) -> DataFrame:
    """A stream of cache operations (cache_id, seq, op, tokens, kv_offset, steps) with their results; the state is the cache."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = ClockCache(capacity)
        if state.exists:
            hand, chunks, free, cells, tokens, offsets, marks, owns = state.get
            cache.hand, cache.chunks, cache.free = hand, chunks, list(free)
            cache.live = {c: [tuple(t), o, m] for c, t, o, m in zip(cells, tokens, offsets, marks, strict=True)}
            cache.cell_of = {cache.live[c][0]: c for c, own in zip(cells, owns, strict=True) if own}
        rows = list(replay_rows(cache, pd.concat(list(batches))))
        cells = sorted(cache.live)
        held = [cache.live[c] for c in cells]
        state.update((cache.hand, cache.chunks, cache.free, cells, [list(e[0]) for e in held], [e[1] for e in held], [e[2] for e in held], [cache.cell_of.get(cache.live[c][0]) == c for c in cells]))
        out = pd.DataFrame(rows, columns=["seq", "op", "token_len", "kv_offset", "evicted"])
        out.insert(0, "cache_id", key[0])
        yield out.astype({"token_len": "Int64", "kv_offset": "Int64", "evicted": "Int64"})

    state = "hand INT, chunks INT, free ARRAY<INT>, cells ARRAY<INT>, tokens ARRAY<ARRAY<BIGINT>>, offsets ARRAY<BIGINT>, marks ARRAY<INT>, owns ARRAY<BOOLEAN>"
    schema = "cache_id BIGINT, seq BIGINT, op STRING, token_len BIGINT, kv_offset BIGINT, evicted BIGINT"
    return ops.groupBy("cache_id").applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)
