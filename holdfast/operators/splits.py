"""Train, validation and test parts, folds, and the random baseline, by hashed key."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import DEFAULT, Rules
from holdfast.functions.exact import hash_bucket, hash_key, rate_pct
from holdfast.operators.joins import join_own_aggregate
from holdfast.operators.selection import values_at_ranks
from holdfast.session import stage

BUCKETS = 10_000


def salted(key: Column, seed: int, purpose: str) -> Column:
    return F.concat(key, F.lit(f"|{purpose}|{seed}"))


def split_of(key: Column, rules: Rules = DEFAULT) -> Column:
    """Part of a row from its key alone: no shuffle, the same in every run."""
    bucket = hash_bucket(salted(key, rules.seed, "split"), BUCKETS)
    test = int(rules.test_share * BUCKETS)
    val = test + int(rules.val_share * BUCKETS)
    return F.when(bucket < test, "test").when(bucket < val, "val").otherwise("train")


def _parts(df: DataFrame, key: str, label: str, purpose: str, ranks: list[Column], rules: Rules) -> DataFrame:
    """Adds ``part``: how many of the ascending ``ranks`` the row reaches in its class, by hash order.

    The cuts of a class are the hash values at the wanted ranks, all taken in one selection;
    rows compare themselves with the cuts of their class, so no class is sorted. Rows with one key stay together.
    """
    hashed = df.withColumn("split_hash", hash_key(salted(F.col(key), rules.seed, purpose)))
    found = values_at_ranks(hashed, [label], "split_hash", F.array(*ranks))
    at = F.map_from_entries(F.collect_list(F.struct("rank", "at_rank")))
    cuts = (
        found.groupBy(label)
        .agg(F.max("total").alias("total"), at.alias("at"))
        .select(label, F.transform(F.array(*ranks), lambda r: F.element_at("at", r)).alias("cuts"))
    )
    # Staged, the cuts are known to be small and the rows need no shuffle to meet them.
    reached = F.size(F.filter("cuts", lambda cut: cut <= F.col("split_hash")))
    return (
        join_own_aggregate(hashed, stage(cuts, "cuts"), [label])
        .withColumn("part", reached)
        .select(*df.columns, "part")
    )


def exact_split(df: DataFrame, key: str, label: str, rules: Rules = DEFAULT) -> DataFrame:
    """Stratified split with exact sizes per class."""

    def upto(share: Decimal) -> Column:
        return F.floor(F.col("total") * F.lit(share).cast("decimal(4,2)")).cast("bigint")

    parts = _parts(df, key, label, "split", [upto(rules.test_share), upto(rules.test_share + rules.val_share)], rules)
    name = F.when(F.col("part") == 0, "test").when(F.col("part") == 1, "val").otherwise("train")
    return parts.withColumn("split", name).select(*df.columns, "split")


def stratified_folds(df: DataFrame, key: str, label: str, rules: Rules = DEFAULT) -> DataFrame:
    """Adds ``fold``: equal folds of every class, whose sizes differ by one row at most."""
    starts = [F.floor(F.col("total") * k / rules.folds).cast("bigint") for k in range(1, rules.folds)]
    return _parts(df, key, label, "fold", starts, rules).withColumnRenamed("part", "fold")


def split_shares(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy("split").agg(
        F.count("*").alias("n"),
        F.sum(label).alias("n_churned"),
        rate_pct(F.sum(label), F.count("*")).cast("double").alias("churn_rate_pct"),
    )


def fold_of(key: Column, rules: Rules = DEFAULT) -> Column:
    return hash_bucket(salted(key, rules.seed, "fold"), rules.folds).cast("int")


def baseline_probability(df: DataFrame, train: DataFrame, key: str, label: str, rules: Rules = DEFAULT) -> DataFrame:
    """0 or 1 at random, 1 as often as the class share of the training rows."""
    bucket = hash_bucket(salted(F.col(key), rules.seed, "baseline"), BUCKETS)
    prior = train.agg(F.struct(F.sum(label).alias("pos"), F.count("*").alias("n")).alias("p"))
    return (
        df.withColumn("prior", prior.scalar())
        .withColumn(
            "churn_probability",
            (bucket * F.col("prior.n") < F.col("prior.pos") * BUCKETS).cast("double"),
        )
        .drop("prior")
    )
