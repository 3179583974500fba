"""Permutation importance: how much a score worsens when one column is dealt anew among the rows.

Every row has two ranks, by two hashes of its key. A row receives the value of the row whose
second rank equals its first one, so a column is permuted exactly - every value is used once - by one
equi-join on the rank, without an order that one task would have to know. Ranks are dealt by ranges of
the hash: blocks are numbered on their own and shifted by the totals of the blocks before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.exact import hash_key
from holdfast.operators.metrics import ranking_metrics
from holdfast.session import stage

BLOCK_BITS = 12


def ranked(df: DataFrame, hashed: Column, name: str, ties: str) -> DataFrame:
    """Adds ``name``: the rank of each row by a 60-bit hash, from 0; ``ties`` orders equal hashes."""
    blocked = df.withColumn("rank_hash", hashed)
    blocked = blocked.withColumn("rank_block", F.shiftright("rank_hash", 60 - BLOCK_BITS).cast("int"))
    # At most 2**BLOCK_BITS totals.
    earlier = Window.orderBy("rank_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("rank_block").agg(F.count("*").alias("n"))
    totals = totals.select("rank_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_before"))
    inside = F.row_number().over(Window.partitionBy("rank_block").orderBy("rank_hash", ties))
    return (
        blocked.withColumn("rank_inside", inside)
        .join(totals, "rank_block")
        .withColumn(name, F.col("rank_before") + F.col("rank_inside") - 1)
        .drop("rank_hash", "rank_block", "rank_inside", "rank_before")
    )


def permuted(df: DataFrame, columns: list[str], key: str, seed: int = 42) -> DataFrame:
    """The rows once per column, in ``permuted_column``, with that column's values permuted.

    All columns are dealt by the same permutation, each in its own copy of the rows.
    """
    salted = lambda purpose: hash_key(F.concat(F.col(key), F.lit(f"|{purpose}|{seed}")))
    once = ranked(df, salted("give"), "give", key)
    both = stage(ranked(once, salted("take"), "take", key), "ranked")
    given = both.select(F.col("give").alias("take"), *[F.col(c).alias(f"given_{c}") for c in columns])
    met = stage(both.join(given, "take"), "permuted")
    copies = [
        met.select(
            F.lit(c).alias("permuted_column"), *[F.col(f"given_{n}").alias(n) if n == c else F.col(n) for n in df.columns]
        )
        for c in columns
    ]
    return reduce(DataFrame.unionByName, copies)


def permutation_importance(score, df: DataFrame, columns: list[str], key: str, seed: int = 42) -> DataFrame:
    """column, roc_auc, loss: area when the column is permuted, and what that loses against ``df`` itself.

    ``score`` maps rows to (key, churn_probability, churned_actual); it is called twice, for the rows as they are
    and for all permuted copies in one.
    """
    # The copies stay apart by their key.
    copies = permuted(df, columns, key, seed)
    name = F.concat(F.col("permuted_column"), F.lit("|"), F.col(key))
    scored = score(copies.withColumn(key, name).drop("permuted_column"))
    scored = scored.withColumn("model_name", F.substring_index(key, "|", 1))
    whole = score(df).withColumn("model_name", F.lit(""))
    areas = stage(ranking_metrics(scored.unionByName(whole)).select("model_name", "roc_auc"), "areas")
    base = areas.filter("model_name = ''").select("roc_auc").scalar()
    return areas.filter("model_name <> ''").select(
        F.col("model_name").alias("column"), "roc_auc", F.round(base - F.col("roc_auc"), 4).alias("loss")
    )
