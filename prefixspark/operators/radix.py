"""The shape of the radix tree over a set of keys, without building one: a node is a prefix of half bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import child_rank, leaf_kind, nibbles, node_family


def key_nibbles(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, position, nibble), positions from 0."""
    return keys.select(key, F.posexplode(nibbles(F.col(key))).alias("position", "nibble"))


def paths(keys: DataFrame, key: str = "key") -> DataFrame:
    """The path that inserting each key makes: one row for each depth from 0 to twice its length."""
    hexed = keys.select(F.col(key).alias("key"), F.hex(key).alias("h"))
    return hexed.select("key", F.explode(F.sequence(F.lit(0), F.length("h"))).alias("depth"), "h").select("key", "depth", F.expr("substring(h, 1, depth)").alias("path"), F.expr("substring(h, depth + 1, 1)").alias("next"))


def nodes(keys: DataFrame, key: str = "key") -> DataFrame:
    """(depth, path, bitmap, n_children, family, has_leaf) of each node. Families follow the children ever inserted."""
    bit = F.when(F.col("next") != "", F.call_function("shiftleft", F.lit(1), F.conv("next", 16, 10).cast("int")))
    grouped = paths(keys, key).groupBy("depth", "path").agg(F.coalesce(F.bit_or(bit), F.lit(0)).alias("bitmap"), F.bool_or(F.col("next") == "").alias("has_leaf"))
    n = F.bit_count("bitmap")
    return grouped.select("depth", "path", "bitmap", n.alias("n_children"), node_family(n).alias("family"), "has_leaf")


def lookup_child(nodes: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (path, nibble) with ``rank`` (the child's place in its node) and ``child`` (its path); nulls if node or child is
    missing."""
    found = probes.join(nodes.select("path", "bitmap"), "path", "left").withColumn("rank", child_rank(F.col("bitmap"), F.col("nibble")))
    child = F.concat("path", F.hex(F.col("nibble").cast("bigint")))
    return found.withColumn("child", F.when(F.col("rank").isNotNull(), child)).drop("bitmap")


def shape(keys: DataFrame, key: str = "key") -> DataFrame:
    """Nodes, children and leaves by depth and family."""
    return nodes(keys, key).groupBy("depth", "family").agg(F.count("*").alias("n_nodes"), F.sum("n_children").alias("n_children"), F.count_if("has_leaf").alias("n_leaves"))


def leaves(state: DataFrame) -> DataFrame:
    """``state`` with the kind of its leaf word."""
    return state.withColumn("leaf", leaf_kind(F.col("value")))
