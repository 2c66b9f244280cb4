"""Keyed store: an operation log becomes states, lookups, previous values and longest stored prefixes.

A log has ``seq`` (a total order), ``op`` ("put" or "del"), ``key`` (binary) and ``value``. Results are those of
applying the log serially by ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free_name


def current(ops: DataFrame) -> DataFrame:
    """(key, value) after the whole log: each key's last operation, unless that deletes. One partial aggregation."""
    last = ops.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("last"))
    return last.where(F.col("last.op") != "del").select("key", F.col("last.value").alias("value"))


def history(ops: DataFrame) -> DataFrame:
    """The log with ``previous`` (the value before, null if none or deleted) and ``existed``."""
    by = Window.partitionBy("key").orderBy("seq")
    live = F.when(F.col("op") != "del", F.col("value"))
    was = F.lag(F.when(F.col("op") != "del", F.lit(1)).otherwise(0), 1, 0).over(by)
    return ops.withColumn("previous", F.lag(live).over(by)).withColumn("existed", was == 1)


def get(state: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (with a column key) with the value, null if the key isn't stored."""
    return probes.join(state.select("key", "value"), "key", "left")


def longest_prefix(state: DataFrame, probes: DataFrame, probe: str = "query") -> DataFrame:
    """``probes`` with ``matched_bytes`` and ``value`` of the longest stored key that is a prefix, nulls if none is.

    The stored lengths (at most one for each length of a key) cut each query into candidate keys, so the match is an
    equi-join and never compares a query with every key. The empty key is a prefix of all.
    """
    lengths = state.agg(F.coalesce(F.collect_set(F.octet_length("key")), F.array().cast("array<int>")).alias("lengths"))  # one row
    asked = probes.select(F.col(probe).cast("binary").alias("q")).dropna().distinct()
    cut = asked.crossJoin(F.broadcast(lengths)).select("q", F.explode(F.filter("lengths", lambda k: k <= F.octet_length("q"))).alias("k"))
    cut = cut.select("q", "k", F.expr("substring(q, 1, k)").alias("key"))
    best = cut.join(state.select("key", "value"), "key").groupBy("q").agg(F.max(F.struct("k", "value")).alias("best"))
    asked_for, longest = free_name(probes, "q"), free_name(probes, "best")
    best = best.select(F.col("q").alias(asked_for), F.col("best").alias(longest))
    found = probes.join(best, F.col(probe).cast("binary") == F.col(asked_for), "left")
    return found.withColumn("matched_bytes", F.col(longest)["k"]).withColumn("value", F.col(longest)["value"]).drop(asked_for, longest)


def stats(state: DataFrame) -> DataFrame:
    """One row: keys, their bytes, and the bytes of values out of line (2^56 and above)."""
    out_of_line = F.when(F.col("value") >= F.lit(1 << 56), 8).otherwise(0)
    return state.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias("key_bytes"), F.coalesce(F.sum(out_of_line), F.lit(0)).alias("slot_bytes"))


def as_key(text: Column) -> Column:
    return F.encode(text, "UTF-8")
