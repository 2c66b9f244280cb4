"""Temporal URL list: dated entries become validity intervals; each capture meets the entries active when it was fetched.

DataFrame functions only. An entry's pattern is a host (which covers its subdomains) or a host and a path prefix by
whole segments. Patterns and URLs are compared in lower case, paths too: an entry for ``a.org/en`` covers ``a.org/En``. Entries of a pattern are first summed by day, so a pattern has at most one row a day; ``lead`` then
gives each state's end. The as-of join is an equi-join on (pattern, month) with the day's bounds checked inside,
so a pattern with many intervals costs a capture at most a month of them. Small lists are broadcast after their
rows are counted; larger ones are shuffled, with the captures of a pattern and month that has very many cut into parts by their
number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS

#: Captures of a pattern and month that meet its intervals in one part.
HOT_CAPTURES = 200_000


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def month_of(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def intervals_of(entries: DataFrame, pattern: str = "pattern", day: str = "day", listed: str = "listed") -> DataFrame:
    """(pattern, valid_from, valid_to): listed from the first day to before the last; null is open. Of entries of one
    pattern and day, "listed" wins. Rows with a null in any of the three columns say nothing and go."""
    picked = entries.select(F.lower(pattern).alias("pattern"), F.col(day).cast("date").alias("day"), F.col(listed).cast("boolean").alias("listed")).dropna()
    daily = picked.groupBy("pattern", "day").agg(F.max("listed").alias("listed"))
    by = Window.partitionBy("pattern").orderBy("day")
    changes = daily.withColumn("before", F.lag("listed").over(by)).where(F.col("before").isNull() | (F.col("before") != F.col("listed")))
    return changes.withColumn("valid_to", F.lead("day").over(by)).where("listed").select("pattern", F.col("day").alias("valid_from"), "valid_to")


def with_keys(pages: DataFrame, depth: DataFrame) -> DataFrame:
    """``pages`` (with a column url) by each pattern that could cover the URL: its host, the hosts above it, and its host with up
    to ``depth`` path segments. Parts are columns before lambdas use them, so they are made once a row."""
    parts = pages.crossJoin(F.broadcast(depth)).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    parts = parts.withColumns({"labels": F.split("host", r"\."), "segments": F.filter(F.split("path", "/"), lambda x: x != "")})
    parts = parts.withColumn("first", F.transform(F.slice("segments", F.lit(1), F.least(F.size("segments"), F.col("depth"))), F.lower))
    hosts = F.transform("labels", lambda _, i: F.array_join(F.slice("labels", i + 1, F.size("labels")), "."))
    paths = F.transform("first", lambda _, i: F.concat(F.col("host"), F.lit("/"), F.array_join(F.slice("first", F.lit(1), i + 1), "/")))
    keys = F.array_distinct(F.filter(F.concat(hosts, paths), lambda k: k != ""))
    return parts.withColumn("keys", keys).select(*pages.columns, F.explode("keys").alias("pattern"))


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched", hot_captures: int = HOT_CAPTURES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per input row: page_id, url, fetched, blocked, pattern (the longest active one, the first by name of
    equals), n_active (active patterns).

    A null or unparsable URL, or a null day, meets no entry and is not blocked. Very long URLs are compared whole, by as many path
    segments as the longest pattern has. Rows that repeat each get the verdict.
    An empty list blocks nothing; an empty capture table gives an empty table. Other columns are not read.
    """
    pages = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(day_col).cast("date").alias("fetched"))
    intervals = intervals_of(entries)
    seen = pages.agg(F.min("fetched").alias("first_day"), F.max("fetched").alias("last_day"))  # one row
    depth = intervals.agg(F.coalesce(F.max(F.size(F.split("pattern", "/"))) - 1, F.lit(0)).alias("depth"))  # one row
    within = intervals.crossJoin(F.broadcast(seen)).where((F.col("valid_from") <= F.col("last_day")) & F.coalesce(F.col("valid_to") > F.col("first_day"), F.lit(True)))
    until = F.least(F.coalesce("valid_to", "last_day"), "last_day")
    months = F.sequence(month_of(F.greatest("valid_from", "first_day")), month_of(until))
    monthly = within.select("pattern", "valid_from", "valid_to", F.explode(months).alias("month"))
    keyed = with_keys(pages.where("url IS NOT NULL AND fetched IS NOT NULL").distinct(), depth).withColumn("month", month_of(F.col("fetched")))
    if monthly.limit(broadcast_rows + 1).count() <= broadcast_rows:
        met = keyed.join(F.broadcast(monthly), ["pattern", "month"])
    else:
        # a capture has a bounded number of keys, so keys this hot are few
        hot = keyed.groupBy("pattern", "month").agg(F.ceil(F.count("*") / hot_captures).cast("int").alias("parts")).where("parts > 1")
        hot = hot if hot.limit(broadcast_rows + 1).count() > broadcast_rows else F.broadcast(hot)
        cut = lambda df: df.join(hot, ["pattern", "month"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        parts = cut(monthly).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        met = cut(keyed).withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.col("parts")).cast("int")).drop("parts").join(parts, ["pattern", "month", "part"])
    met = met.where((F.col("fetched") >= F.col("valid_from")) & F.coalesce(F.col("fetched") < F.col("valid_to"), F.lit(True)))
    best = F.min(F.struct((-F.length("pattern")).alias("l"), "pattern"))["pattern"]
    verdict = met.groupBy("page_id", "url", "fetched").agg(best.alias("pattern"), F.countDistinct("pattern").alias("n_active"))
    v = verdict.select(F.col("page_id").alias("v_id"), F.col("url").alias("v_url"), F.col("fetched").alias("v_day"), "pattern", "n_active")
    same = F.col("page_id").eqNullSafe(F.col("v_id")) & (F.col("url") == F.col("v_url")) & (F.col("fetched") == F.col("v_day"))
    return pages.join(v, same, "left").select("page_id", "url", "fetched", F.col("pattern").isNotNull().alias("blocked"), "pattern", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"))
