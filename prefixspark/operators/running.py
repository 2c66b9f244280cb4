"""Running sums and previous rows over groups of any size: no task sees a whole group.

The order's values are cut at quantiles into ranges of about ``ROWS`` rows, the same for all groups. A window runs within (group,
range); what the ranges before add comes from one row for each (group, range). Ties of the order must not matter to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free_name

ROWS, MOST_RANGES = 200_000, 10_000


def range_of(df: DataFrame, order: Column, rows: int = 0) -> Column:
    """The number of a row's range: a fixed function of the order's value, so it holds when a row is computed again."""
    n = df.count()
    parts = min(MOST_RANGES, -(-n // (rows or ROWS)))
    if parts <= 1:
        return F.lit(0)
    name = free_name(df, "at")
    cuts = sorted(set(df.select(order.cast("double").alias(name)).approxQuantile(name, [i / parts for i in range(1, parts)], 0.25 / parts)))
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= order.cast("double"))) if cuts else F.lit(0)


def _same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & left[f"`{a}`"].eqNullSafe(right[f"`{b}`"])
    return out


def sum_before(df: DataFrame, value: Column, group: str | None, order: str, name: str, rows: int = 0) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the group (all rows without one) that come before, 0 at the first."""
    at, v, one, g, a, before = (free_name(df, n) for n in ("range", "value_of", "all_rows", "group_of", "range_of", "before"))
    of = group or one
    cut = df.withColumn(at, range_of(df, F.col(order), rows)).withColumn(v, value).withColumn(one, F.lit(0))
    sums = cut.groupBy(F.col(of).alias(g), F.col(at).alias(a)).agg(F.sum(v).alias(before))
    earlier = F.sum(before).over(Window.partitionBy(g).orderBy(a).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(g, a, F.coalesce(earlier, F.lit(0)).alias(before))
    within = F.sum(v).over(Window.partitionBy(of, at).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    cut = cut.withColumn(name, F.coalesce(within, F.lit(0)))
    joined = cut.join(sums, _same(cut, sums, [(of, g), (at, a)]))
    return joined.withColumn(name, F.col(name) + F.col(before)).drop(at, v, one, g, a, before)


def row_before(df: DataFrame, values: list[str], group: str | None, order: str, name: str, rows: int = 0) -> DataFrame:
    """``df`` with ``name``: a struct of ``values`` of the row before in the group (of all rows without one), null at the first."""
    at, one, g, a, last = (free_name(df, n) for n in ("range", "all_rows", "group_of", "range_of", "last_row"))
    cut = df.withColumn(at, range_of(df, F.col(order), rows)).withColumn(one, F.lit(0))
    of = group or one
    told = F.struct(*values)
    lasts = cut.groupBy(F.col(of).alias(g), F.col(at).alias(a)).agg(F.max_by(told, order).alias(last))
    lasts = lasts.select(g, a, F.lag(last).over(Window.partitionBy(g).orderBy(a)).alias(last))
    cut = cut.withColumn(name, F.lag(told).over(Window.partitionBy(of, at).orderBy(order)))
    joined = cut.join(lasts, _same(cut, lasts, [(of, g), (at, a)]))
    return joined.withColumn(name, F.coalesce(name, last)).drop(at, one, g, a, last)
