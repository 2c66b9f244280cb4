"""Sizes and shares as text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Binary suffixes, and the two cells of a bar.
SUFFIXES = {"KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}
FULL, EMPTY = "▓", "░"


def parse_size(text: Column) -> Column:
    """Bytes of ``64MB`` or ``1024``; null if it is neither."""
    number, suffix = F.regexp_extract(F.trim(text), r"^([0-9]+)(KB|MB|GB)?$", 1), F.regexp_extract(F.trim(text), r"^([0-9]+)(KB|MB|GB)?$", 2)
    factor = F.lit(1)
    for name, value in SUFFIXES.items():
        factor = F.when(suffix == name, F.lit(value)).otherwise(factor)
    return F.when(number != "", F.try_multiply(number.try_cast("bigint"), factor.cast("bigint")))


def format_bytes(n: Column) -> Column:
    out = F.format_string("%d B", n.cast("bigint"))
    for name, value in zip(("KiB", "MiB", "GiB"), SUFFIXES.values(), strict=True):
        out = F.when(n >= value, F.format_string(f"%.1f {name}", F.bround(n / F.lit(float(value)), 1))).otherwise(out)
    return out


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", F.bround(share * 100, 1))


def bar(share: Column, width: int) -> Column:
    cells = max(width - 2, 1)
    full = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * cells).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit(FULL), full), F.repeat(F.lit(EMPTY), F.lit(cells) - full), F.lit("]"))
