"""One row per key without sorting the table."""

import re

from pyspark.sql import functions as F

from holdfast.operators.keyed import first_per_key, last_per_key


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_one_row_per_key_with_null_keys_and_orders(spark):
    rows = [
        ("a", 1, 5, "x"), ("a", 1, 3, "y"), ("a", 2, 9, "z"), (None, 1, 2, "n"), (None, 1, 1, "m"), (None, None, 4, "o"),
        ("b", 1, None, "late"), ("b", 1, 7, "early"), ("c", 1, None, "only"),
    ]
    df = spark.createDataFrame(rows, "k string, l int, seq int, v string")
    first = [("a", 1, 3, "y"), ("a", 2, 9, "z"), (None, 1, 1, "m"), (None, None, 4, "o"), ("b", 1, 7, "early"), ("c", 1, None, "only")]
    assert rows_of(first_per_key(df, ["k", "l"], F.col("seq"))) == sorted(first, key=str)
    last = [("a", 1, 5, "x"), ("a", 2, 9, "z"), (None, 1, 2, "n"), (None, None, 4, "o"), ("b", 1, 7, "early"), ("c", 1, None, "only")]
    assert rows_of(last_per_key(df, ["k", "l"], F.col("seq"))) == sorted(last, key=str)
    assert first_per_key(df.limit(0), ["k"], F.col("seq")).count() == 0


def test_equal_orders_leave_one_row(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 1, "z")], "k string, seq int, v string")
    assert first_per_key(df, ["k"], F.col("seq")).count() == 1


def test_rows_of_single_keys_are_neither_sorted_nor_shuffled(spark, tmp_path):
    spark.range(50_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"), "id", F.lit("v").alias("v")
    ).write.parquet(str(tmp_path / "t"))
    out = first_per_key(spark.read.parquet(str(tmp_path / "t")), ["k"], F.col("id"))
    got = out.collect()
    assert len(got) == 50_000 - 16_666 and next(r for r in got if r["k"] == "hot")["id"] == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    once = plan[plan.index("Union") :].split("LeftAnti")[0]
    assert "BroadcastHashJoin" in plan and not re.search(r"Sort |Exchange hash", once)
