from pyspark.sql import functions as F

from holdfast.config import DEFAULT
from holdfast.operators import splits
from holdfast.operators.fingerprint import fingerprint


def people(spark, n=4000):
    return spark.range(n).select(
        F.concat(F.lit("P"), F.col("id")).alias("pid"), (F.col("id") % 5 == 0).cast("int").alias("churned")
    )


def test_hash_split_is_stable_and_near_the_shares(spark):
    df = people(spark).withColumn("split", splits.split_of(F.col("pid")))
    again = people(spark).repartition(7).withColumn("split", splits.split_of(F.col("pid")))
    assert df.exceptAll(again).count() == 0
    n = {r["split"]: r["n"] for r in splits.split_shares(df, "churned").collect()}
    assert abs(n["test"] / 4000 - 0.20) < 0.03 and abs(n["val"] / 4000 - 0.15) < 0.03


def test_exact_split_has_exact_sizes_per_class(spark):
    out = splits.exact_split(people(spark), "pid", "churned")
    got = {(r["churned"], r["split"]): r["count"] for r in out.groupBy("churned", "split").count().collect()}
    assert got == {
        (0, "test"): 640, (0, "val"): 480, (0, "train"): 2080,
        (1, "test"): 160, (1, "val"): 120, (1, "train"): 520,
    }


def test_exact_split_of_few_rows_keeps_all(spark):
    out = splits.exact_split(people(spark, 3), "pid", "churned")
    assert out.count() == 3


def test_folds_cover_all_rows(spark):
    got = people(spark).groupBy(splits.fold_of(F.col("pid")).alias("f")).count().collect()
    assert sorted(r["f"] for r in got) == list(range(DEFAULT.folds))
    assert sum(r["count"] for r in got) == 4000


def test_baseline_predicts_the_class_share(spark):
    df = people(spark)
    out = splits.baseline_probability(df, df, "pid", "churned")
    row = out.agg(F.avg("churn_probability").alias("m"), F.count("*").alias("n")).first()
    assert row["n"] == 4000 and abs(row["m"] - 0.2) < 0.03
    assert {r[0] for r in out.select("churn_probability").distinct().collect()} == {0.0, 1.0}


def test_fingerprint_ignores_order_but_not_content(spark):
    df = people(spark, 100)
    one = fingerprint(df).first()["data_hash"]
    assert len(one) == 16
    assert fingerprint(df.orderBy(F.desc("pid")).repartition(5)).first()["data_hash"] == one
    assert fingerprint(df.filter("pid != 'P7'")).first()["data_hash"] != one
    changed = df.withColumn("churned", F.when(F.col("pid") == "P7", 1).otherwise(F.col("churned")))
    assert fingerprint(changed).first()["data_hash"] != one
    nulls = spark.createDataFrame([(None, "a")], "x string, y string")
    swapped = spark.createDataFrame([("a", None)], "x string, y string")
    assert fingerprint(nulls).first() != fingerprint(swapped).first()


def test_fingerprint_keeps_cells_apart(spark):
    one = lambda *row: fingerprint(spark.createDataFrame([row], "a string, b string")).first()["data_hash"]
    assert one("a|b", "c") != one("a", "b|c")
    assert one(None, "c") != one("~", "c")


def test_folds_are_equal_within_every_class(spark):
    df = people(spark, 1003).withColumn("churned", F.when(F.col("pid") == "P7", F.lit(None)).otherwise(F.col("churned")))
    out = splits.stratified_folds(df, "pid", "churned").collect()
    assert len(out) == 1003 and {r["fold"] for r in out} == set(range(DEFAULT.folds))
    for label in (0, 1):
        sizes = [sum(r["fold"] == k and r["churned"] == label for r in out) for k in range(DEFAULT.folds)]
        assert max(sizes) - min(sizes) <= 1
    again = splits.stratified_folds(df.repartition(9), "pid", "churned")
    assert {(r["pid"], r["fold"]) for r in again.collect()} == {(r["pid"], r["fold"]) for r in out}


def test_folds_of_fewer_rows_than_folds(spark):
    out = splits.stratified_folds(people(spark, 3), "pid", "churned").collect()
    assert len(out) == 3 and all(0 <= r["fold"] < DEFAULT.folds for r in out)
