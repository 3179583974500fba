"""Permutation importance."""

from pyspark.sql import functions as F

from holdfast.operators.importance import permutation_importance, permuted, ranked


def people(spark, n=600):
    return spark.range(n).select(
        F.concat(F.lit("P"), F.col("id")).alias("pid"),
        (F.crc32(F.concat(F.lit("a"), "id")) % 100).alias("signal"),
        (F.crc32(F.concat(F.lit("b"), "id")) % 100).alias("noise"),
    ).withColumn("churned", (F.col("signal") < 30).cast("int"))


def test_ranks_are_a_permutation(spark):
    df = ranked(people(spark), F.shiftleft(F.crc32("pid").cast("bigint") % 50, 54), "rank", "pid")
    assert sorted(r["rank"] for r in df.collect()) == list(range(600))
    assert ranked(people(spark).limit(0), F.lit(0).cast("bigint"), "rank", "pid").count() == 0


def test_every_value_is_used_once_and_other_columns_stay(spark):
    df = people(spark)
    copies = permuted(df, ["signal", "noise"], "pid")
    own = {r["pid"]: r for r in df.collect()}
    for column, other in (("signal", "noise"), ("noise", "signal")):
        rows = copies.filter(F.col("permuted_column") == column).collect()
        assert sorted(r[column] for r in rows) == sorted(r[column] for r in own.values())
        assert all(r[other] == own[r["pid"]][other] and r["churned"] == own[r["pid"]]["churned"] for r in rows)
        assert sum(r[column] != own[r["pid"]][column] for r in rows) > 500
    assert copies.exceptAll(permuted(df.repartition(7), ["signal", "noise"], "pid")).count() == 0


def test_only_the_column_that_carries_the_label_matters(spark):
    def score(df):
        p = 1 - F.col("signal") / 100.0
        return df.select("pid", p.alias("churn_probability"), F.col("churned").alias("churned_actual"))

    got = {r["column"]: r for r in permutation_importance(score, people(spark), ["signal", "noise"], "pid").collect()}
    assert got["noise"]["loss"] == 0 and got["noise"]["roc_auc"] == 1
    assert got["signal"]["loss"] > 0.35 and 0.35 < got["signal"]["roc_auc"] < 0.65
