"""Allocation accounting: bump allocation, slab classes and slots, snapshot reclamation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidNodeType, require
from ..functions.bits import NODE_TYPES
from .running import sum_before

# Slab classes as (number, node type, slot bytes, slots in a chunk).
SLAB_CLASSES = ((0, "Node4", 48, 83), (1, "Node16", 152, 26), (2, "Node64", 528, 7), (3, "Node256", 2064, 1))


def bump(allocations: DataFrame, capacity: int, arena: str = "arena") -> DataFrame:
    """``allocations`` (arena, seq, size, align) with ``reserved``, ``raw`` (the frontier before), ``start`` (aligned) and ``fits``.

    Each takes size + align - 1 bytes of the frontier, also when it fails; it fails if its end passes the capacity.
    """
    out = allocations.withColumn("reserved", F.col("size") + F.col("align") - 1)
    out = sum_before(out, F.col("reserved"), arena, "seq", "raw")
    out = out.withColumn("start", (F.col("raw") + F.col("align") - 1).bitwiseAND(F.bitwise_not(F.col("align") - 1)))
    return out.withColumn("fits", F.col("start") + F.col("size") <= capacity)


def remaining(frontier: Column, capacity: int) -> Column:
    return F.greatest(F.lit(0), F.lit(capacity) - frontier)


def in_bounds(offset: Column, size: Column, align: Column, frontier: Column) -> Column:
    """Whether an access lies below the frontier and on its alignment."""
    return (offset % align == 0) & (offset >= 0) & (offset + size <= frontier)


def slab_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SLAB_CLASSES, "class INT, node_type STRING, slot_size INT, slots INT").withColumn("chunk_size", F.col("slot_size") * F.col("slots"))


def node_type_of(number: int) -> str:
    """The node type of a number; 6 and above are not valid."""
    require(0 <= number < len(NODE_TYPES), f"no node type {number}", InvalidNodeType)
    return NODE_TYPES[number]


def class_of(node_type: str) -> int:
    found = next((c for c, name, *_ in SLAB_CLASSES if name == node_type), None)
    require(found is not None, f"{node_type} has no slab class", InvalidNodeType)
    return found  # type: ignore[return-value]


def slab_capacity(pools: DataFrame) -> DataFrame:
    """``pools`` (capacity) by class: whole chunks and slots."""
    return pools.crossJoin(F.broadcast(slab_classes(pools.sparkSession))).withColumn("chunks", F.floor(F.col("capacity") / F.col("chunk_size"))).withColumn("n_slots", F.col("chunks") * F.col("slots"))


def slab_replay(ops: DataFrame, capacity: int) -> DataFrame:
    """Offsets that a pool hands out: ops are (pool, class, seq, op "alloc"/"free", offset of a free).

    Free slots of a class form a stack; an empty stack gets a new chunk, whose highest slot is on top. Sequential by
    (pool, class), so each is one group; null offsets mean that the budget is spent.
    """
    sizes = {c: (slot, n) for c, _, slot, n in SLAB_CLASSES}

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        slot, n = sizes[int(pdf["class"].iloc[0])]
        stack: list[int] = []
        chunks, out = 0, []
        for op, offset in pdf.sort_values("seq")[["op", "offset"]].itertuples(index=False):
            if op == "free":
                stack.append(int(offset))
                out.append(int(offset))
                continue
            if not stack and (chunks + 1) * slot * n <= capacity:
                stack = [chunks * slot * n + i * slot for i in range(n)]
                chunks += 1
            out.append(stack.pop() if stack else None)
        done = pdf.sort_values("seq")[["pool", "class", "seq", "op"]].copy()
        done["offset"] = pd.array(out, "Int64")
        return done

    return ops.groupBy("pool", "class").applyInPandas(replay, "pool BIGINT, class INT, seq BIGINT, op STRING, offset BIGINT")


def slab_report(spark: SparkSession, capacity: int) -> DataFrame:
    """One row: allocated (a pool's slots of the first class until none is left), recycled (those that are handed out again after
    every other slot came back)."""
    n = capacity // (SLAB_CLASSES[0][2] * SLAB_CLASSES[0][3]) * SLAB_CLASSES[0][3]
    fixed = "CAST(0 AS BIGINT) AS pool", "0 AS class"
    first = slab_replay(spark.range(n + 1).selectExpr(*fixed, "id AS seq", "'alloc' AS op", "CAST(NULL AS BIGINT) AS offset"), capacity)
    held = first.where("offset IS NOT NULL")
    back = held.where("seq % 2 = 0").select("pool", "class", (F.col("seq") + n + 1).alias("seq"), F.lit("free").alias("op"), "offset")
    every = first.select("pool", "class", "seq", "op", F.lit(None).cast("bigint").alias("offset")).unionByName(back)
    every = every.unionByName(spark.range(n + 1).selectExpr(*fixed, f"id + {2 * n + 2} AS seq", "'alloc' AS op", "CAST(NULL AS BIGINT) AS offset"))
    got = slab_replay(every, capacity).where("op = 'alloc' AND offset IS NOT NULL")
    return got.agg(F.count_if(F.col("seq") <= n).alias("allocated"), F.count_if(F.col("seq") > n).alias("recycled"))


def reclaimable(current_era: Column, retired_era: Column, least_active: Column) -> Column:
    """Whether what was retired can go: without readers one era later, with readers two, all of them past it."""
    age = current_era - retired_era
    return F.when(least_active.isNull(), age >= 1).otherwise((least_active > retired_era) & (age >= 2))


def hazard_replay(ops: DataFrame) -> DataFrame:
    """What each operation of a reclamation manager gives: ops are (manager, seq, op, id) with op "register", "refresh" or "release" (id
    is the reader), "retire" (id is what goes), "advance" or "reclaim". Returns (manager, seq, op, era, reclaimed): the era after it,
    and for a reclaim how many retired things it lets go, by the rule of ``reclaimable``.

    A reader holds the era of its registration or last refresh. Sequential by manager, so each is one group.
    """

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        era, readers, retired, eras, gone = 0, {}, [], [], []
        pdf = pdf.sort_values("seq")
        for op, name in pdf[["op", "id"]].itertuples(index=False):
            let_go = None
            if op in ("register", "refresh"):
                if op == "register" or name in readers:
                    readers[name] = era
            elif op == "release":
                readers.pop(name, None)
            elif op == "retire":
                retired.append(era)
            elif op == "advance":
                era += 1
            else:
                least = min(readers.values(), default=None)
                stays = [r for r in retired if not (era - r >= 1 if least is None else least > r and era - r >= 2)]
                let_go, retired = len(retired) - len(stays), stays
            eras.append(era)
            gone.append(let_go)
        return pdf[["manager", "seq", "op"]].assign(era=eras, reclaimed=pd.array(gone, "Int64"))

    return ops.groupBy("manager").applyInPandas(replay, "manager BIGINT, seq BIGINT, op STRING, era BIGINT, reclaimed BIGINT")


def vacuum(generations: DataFrame, readers: DataFrame, current_era: int) -> DataFrame:
    """``generations`` (generation, retired_era) with ``reclaim``; readers are (era)."""
    least = readers.agg(F.min("era").alias("least_active"))  # one row
    return generations.crossJoin(F.broadcast(least)).withColumn("reclaim", reclaimable(F.lit(current_era), F.col("retired_era"), F.col("least_active")))

