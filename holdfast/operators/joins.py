"""Join of a table with an aggregate of itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_own_aggregate(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join on ``keys`` where both sides come from the same shuffle.

    The comparison is null-safe. A plain equality would push "key is not null" filters
    into both sides, differently, and Spark could no longer see that they read the
    same exchange; it would compute the common input twice.
    """
    renamed = right.withColumnsRenamed({k: f"own_{k}" for k in keys})
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in keys]
    )
    return left.join(renamed, same).drop(*[f"own_{k}" for k in keys])
