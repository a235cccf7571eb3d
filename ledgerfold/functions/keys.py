"""Keys, half-open ranges and null-safe comparison.

Keys order by their bytes (Spark's order of binary and of uncollated strings). A range is [lo, hi);
a null lo or hi is unbounded. An empty string is an ordinary key, never "unbounded".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_range(key: Column, lo: Column | None, hi: Column | None) -> Column:
    out = F.lit(True)
    if lo is not None:
        out = out & (lo.isNull() | (key >= lo))
    if hi is not None:
        out = out & (hi.isNull() | (key < hi))
    return out


def between(key: str, start: str | None, end: str | None) -> Column:
    """Range with literal bounds; reaches the Parquet scan as pushed filters."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(key) >= start)
    if end is not None:
        out = out & (F.col(key) < end)
    return out


def overlaps(lo: Column, hi: Column, start: Column, end: Column) -> Column:
    """Whether [lo, hi) and [start, end) share a key; an empty range overlaps nothing."""
    some = lambda a, b: a.isNull() | b.isNull() | (a < b)
    return some(lo, hi) & some(start, end) & some(lo, end) & some(start, hi)


def same(expected: Column, current: Column) -> Column:
    """Equality in which null means absent, so absent equals absent."""
    return expected.eqNullSafe(current)


def padded(prefix: str, number: Column, width: int = 12) -> Column:
    """Keys whose order is that of the numbers."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def digest(*columns: str) -> Column:
    """Fingerprint of a command, for equality only."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
