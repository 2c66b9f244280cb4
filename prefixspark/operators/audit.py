"""Consistency audits: upsert storms, crash cuts of a log, memory pressure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a56
from . import arena, kv, wal
from .running import sum_before

# The storm's key prefix, and the stride of the pressure audit's sample.
STORM_PREFIX, SAMPLE_STRIDE = "storm:", 97


def storm_key(index: Column) -> Column:
    return F.encode(F.concat(F.lit(STORM_PREFIX), F.lpad(F.lower(F.hex(index)), 12, "0")), "UTF-8")


def storm_ops(spark: SparkSession, workers: int, attempts: int, keyspace: int) -> DataFrame:
    """The operations of all workers in step: (seq, op, key, value, worker, read_at, write_at). In each round every worker looks at its
    key, then every worker writes it; each does its share of the attempts over the same keys. ``seq`` is the time of writing."""
    n = max(workers, 1)
    every = spark.range(attempts // n * n).select((F.col("id") % n).alias("worker"), F.floor(F.col("id") / n).alias("attempt"))
    at = 2 * n * F.col("attempt") + F.col("worker")
    ops = every.select((at + n).alias("seq"), F.lit("put").alias("op"), storm_key(F.col("attempt") % keyspace).alias("key"), "worker", at.alias("read_at"), (at + n).alias("write_at"))
    return ops.withColumn("value", fnv1a56("key"))


def storm_audit(spark: SparkSession, workers: int, attempts: int, keyspace: int) -> DataFrame:
    """One row: verified, lost. Every key below the lesser of keyspace and share must hold its value."""
    state = kv.current(storm_ops(spark, workers, attempts, keyspace))
    verified = 0 if workers == 0 else min(keyspace, attempts // workers)
    wanted = spark.range(verified).select(storm_key(F.col("id")).alias("key")).withColumn("expected", fnv1a56("key"))
    held = wanted.join(state, "key", "left")
    return held.agg(F.count("*").alias("verified"), F.count_if(~F.col("value").eqNullSafe(F.col("expected"))).alias("lost"))


def contention_rate(contended: Column, attempts: Column) -> Column:
    return F.when(attempts == 0, F.lit(0.0)).otherwise(contended * 100.0 / attempts)


def storm_contention(ops: DataFrame) -> DataFrame:
    """One row: attempts, contended (writes that replace another value than their worker saw when it looked), rate. Looks and writes
    of a key are put in order of time; each sees the last write before it."""
    looks = ops.select("key", F.col("read_at").alias("at"), "write_at", F.lit(None).cast("bigint").alias("value"))
    writes = ops.select("key", F.col("write_at").alias("at"), "write_at", "value")
    is_write = F.col("at") == F.col("write_at")
    sees = F.last(F.when(is_write, F.col("value")), ignorenulls=True).over(Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    seen = looks.unionByName(writes).withColumn("sees", sees)
    pairs = seen.groupBy("key", "write_at").agg(F.max(F.when(~is_write, F.col("sees"))).alias("looked"), F.max(F.when(is_write, F.col("sees"))).alias("replaced"))
    out = pairs.agg(F.count("*").alias("attempts"), F.count_if(~F.col("looked").eqNullSafe(F.col("replaced"))).alias("contended"))
    return out.withColumn("rate", contention_rate(F.col("contended"), F.col("attempts")))


def crash_audit(frames: DataFrame, survivors: int) -> DataFrame:
    """The image after the log is cut behind its first transactions."""
    return wal.replay(wal.commit_order(frames).where(F.col("tx_id") < survivors), order="order")


def crash_cycle(spark: SparkSession, transactions: int, survivors: int) -> DataFrame:
    """One row: written, replayed, survived, consistent, high_water, log_bytes. Each transaction allocates eight bytes and writes its
    number there; the log, as bytes, is cut behind the survivors, parsed and replayed."""
    n = spark.range(2 * transactions).withColumn("tx_id", F.floor(F.col("id") / 2)).withColumn("offset", 8 * F.col("tx_id"))
    last = F.col("id") % 2 == 1
    swap = lambda h: F.concat(*(F.substring(h, i, 2) for i in range(15, 0, -2)))
    payload = F.when(last, F.unhex(swap(F.lpad(F.hex("tx_id"), 16, "0")))).otherwise(wal.region_payload(F.lit(8)))
    opcode = F.when(last, F.lit(wal.opcode_of("Update"))).otherwise(F.lit(wal.opcode_of("Alloc"))).cast("tinyint")
    frames = n.select(F.lit(0).cast("bigint").alias("log_id"), "tx_id", (F.col("id") % 2).cast("int").alias("pos"), last.alias("is_parent"), opcode.alias("opcode"), "offset", payload.alias("payload"))
    ordered = wal.commit_order(frames)
    whole = wal.encode_logs(ordered).agg(F.sum(F.octet_length("bytes")).alias("log_bytes"))
    replayed = wal.parse_logs(wal.encode_logs(ordered.where(F.col("tx_id") < survivors)))
    held = wal.replay(replayed).groupBy(F.floor(F.col("address") / 8).alias("tx_id")).agg(F.sum(F.col("byte") * F.pow(F.lit(256.0), F.col("address") % 8)).cast("bigint").alias("value"), F.count("*").alias("n"))
    kept = min(survivors, transactions)
    good = spark.range(kept).withColumnRenamed("id", "tx_id").join(held, "tx_id", "left").agg(F.count_if((F.col("n") == 8) & (F.col("value") == F.col("tx_id"))).alias("survived"))
    out = good.crossJoin(whole).crossJoin(wal.high_water(replayed))  # one row each
    return out.select(F.lit(transactions).cast("bigint").alias("written"), F.lit(kept).cast("bigint").alias("replayed"), "survived", (F.col("survived") == kept).alias("consistent"), "high_water", "log_bytes")


def crash_cycles(spark: SparkSession, cycles: int, transactions: int = 512, period: int = 400) -> DataFrame:
    """A row for each cycle: the first cuts the log behind one transaction, the next behind two, up to ``period``, then anew."""
    out = None
    for cycle in range(cycles):
        row = crash_cycle(spark, transactions, cycle % period + 1).select(F.lit(cycle).alias("cycle"), "*")
        out = row if out is None else out.unionByName(row)
    return out if out is not None else crash_cycle(spark, 1, 1).select(F.lit(0).alias("cycle"), "*").limit(0)


def pressure(spark: SparkSession, capacity: int, slab_capacity: int = 1 << 16) -> DataFrame:
    """One row: inserted, frontier, capacity, verified (every 97th key, read back), allocated, recycled. Keys are filled in until the
    first that the arena can't hold; each takes its bytes and eight for its value, on eights."""
    most = capacity // 21 + 1
    items = spark.range(most).select("id", F.lit(0).alias("arena"), F.encode(F.concat(F.lit("fill:"), F.lpad(F.lower(F.hex("id")), 8, "0")), "UTF-8").alias("key"))
    items = items.select(F.col("id").alias("seq"), "arena", "key", (F.octet_length("key") + 8).cast("bigint").alias("size"), F.lit(8).cast("bigint").alias("align"))
    stored = arena.bump(items, capacity).where("fits")
    ops = stored.select("seq", F.lit("put").alias("op"), "key", F.col("seq").alias("value"))
    found = sample(kv.get(kv.current(ops), ops.select("key", F.col("seq").alias("wanted"))), "wanted")
    row = stored.agg(F.count("*").alias("inserted"), F.coalesce(F.max(F.col("raw") + F.col("reserved")), F.lit(0)).alias("frontier"))
    verified = found.agg(F.count_if(F.col("value") == F.col("wanted")).alias("verified"))
    return row.withColumn("capacity", F.lit(capacity).cast("bigint")).crossJoin(verified).crossJoin(arena.slab_report(spark, slab_capacity))  # one row each


def fill(items: DataFrame, capacity: int, size: str, order: str, group: str) -> DataFrame:
    """``items`` with ``used`` (after each) and ``stored``, up to the capacity of each group."""
    filled = sum_before(items, F.col(size), group, order, "used").withColumn("used", F.col("used") + F.col(size))
    return filled.withColumn("stored", F.col("used") <= capacity)


def sample(items: DataFrame, index: str) -> DataFrame:
    """Every 97th item, the pressure audit's spot check."""
    return items.where(F.pmod(F.col(index), F.lit(SAMPLE_STRIDE)) == 0)
