"""Operators that keep one row per key, and the upsert built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.session import stage


def _same_key(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys, null keys being equal; columns of ``left`` only."""
    own = right.select(*[F.col(f"`{k}`").alias(f"repeated_{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(own[f"repeated_{i}"]) for i, k in enumerate(keys)])
    return left.join(own, same, how)


def _one_per_key(df: DataFrame, keys: list[str], pick, order: Column) -> DataFrame:
    """Whole rows are only touched where their key repeats.

    A count per key, combined before the shuffle, finds the repeated keys. All other rows pass by a join
    with these alone - broadcast while they are few, and then without a shuffle. The rows of repeated
    keys meet in an aggregate instead of row_number(), so that a key with a large share of the rows is combined
    before it reaches a task.
    """
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1").select(*keys)
    repeated = stage(repeated, "repeated_keys")
    rest = [c for c in df.columns if c not in keys]
    several = _same_key(df, repeated, keys, "left_semi")
    picked = several.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("row"))
    once = _same_key(df, repeated, keys, "left_anti")
    return once.unionByName(picked.select(*keys, "row.*").select(*df.columns))


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Row with the lowest order per key; rows without an order come last."""
    return _one_per_key(df, keys, F.min_by, F.struct(order.isNull(), order))


def last_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Row with the highest order per key; rows without an order come first."""
    return _one_per_key(df, keys, F.max_by, F.struct(order.isNotNull(), order))


def upsert(existing: DataFrame | None, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``existing`` replaced or extended by ``batch``.

    Within the batch the row with the highest ``order`` column wins, and any batch
    row wins over an existing one. ``order`` is not part of the result. The caller
    writes the result to a new path, never over the one being read.
    """
    columns = [c for c in batch.columns if c != order]
    tagged = batch.withColumn("load_rank", F.struct(F.lit(1).alias("load"), F.col(order).alias("seq")))
    tagged = tagged.select(*columns, "load_rank")
    if existing is not None:
        seq_type = batch.schema[order].dataType
        old = existing.select(*columns).withColumn(
            "load_rank",
            F.struct(F.lit(0).alias("load"), F.lit(None).cast(seq_type).alias("seq")),
        )
        tagged = old.unionByName(tagged)
    return last_per_key(tagged, keys, F.col("load_rank")).select(*columns)


def insert_absent(existing: DataFrame | None, seed: DataFrame, key: str, id_col: str) -> DataFrame:
    """Seed rows whose key is not there yet, added to the existing rows.

    Added rows are numbered in seed order, on from the highest id that is there.
    """
    if existing is None:
        return seed
    highest = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("highest")).scalar()
    # The window spans the absent seed rows only, a handful.
    position = F.row_number().over(Window.orderBy(id_col))
    added = seed.join(existing.select(key), key, "left_anti").withColumn(id_col, position)
    added = added.withColumn(id_col, (F.col(id_col) + highest).cast(existing.schema[id_col].dataType))
    return existing.unionByName(added)


def n_repeats(key: Column) -> Column:
    """Rows beyond the first of each key; repeated null keys count as repeats."""
    present = F.count(key)
    nulls = F.count_if(key.isNull())
    return (present - F.countDistinct(key)) + F.greatest(nulls - 1, F.lit(0))
