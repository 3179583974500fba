"""Arithmetic whose result does not depend on partitioning or engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, places: int) -> Column:
    """Decimal quotient rounded half away from zero; null when ``den`` is zero or null.

    The widths leave 17 fractional digits before the final rounding.
    """
    return F.round(F.try_divide(num.cast("decimal(24,4)"), den.cast("decimal(12,0)")), places)


def rate_pct(part: Column, whole: Column, places: int = 2) -> Column:
    """``part`` as a percentage of ``whole``."""
    return ratio(part * 100, whole, places)


def mean(col: str, places: int) -> Column:
    """Average of the non-null values, rounded."""
    return ratio(F.sum(col), F.count(col), places)


def share(part: Column, whole: Column) -> Column:
    """Unrounded percentage as double, zero when ``whole`` is zero."""
    return F.coalesce(
        F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0), F.lit(0.0)
    )


def int_div(a: Column, b) -> Column:
    """Integer division that truncates towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def clip(col: Column, low, high) -> Column:
    """Bound a column on both sides, nulls stay null."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def hash_key(col: Column) -> Column:
    """60-bit integer from the md5 of a text column."""
    return F.conv(F.substring(F.md5(col), 1, 15), 16, 10).cast("bigint")


def hash_bucket(col: Column, n_buckets: int = 10_000) -> Column:
    """Stable bucket 0..n_buckets-1 of a text key."""
    return F.pmod(hash_key(col), F.lit(n_buckets))


def not_nan(col: Column) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(col), col)
