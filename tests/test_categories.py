"""The index of category values and the encoder that the trainers use."""

import pytest
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators import categories


@pytest.fixture
def few(spark):
    rows = [("b", "x"), ("a", None), (None, "y"), ("c", "x"), ("a", "x"), ("o'neil \\ é", "x")]
    return spark.createDataFrame(rows, "one string, two string")


def test_positions_are_ascending_per_column(few):
    index = categories.category_index(few, ["one", "two"])
    got = {(r["name"], r["value"]): r["position"] for r in index.collect()}
    assert got == {
        ("one", "a"): 0, ("one", "b"): 1, ("one", "c"): 2, ("one", "o'neil \\ é"): 3, ("two", "x"): 0, ("two", "y"): 1,
    }
    assert categories.category_sizes(index, ["one", "two", "three"]) == {"one": 4, "two": 2, "three": 0}


def test_no_columns_and_no_rows(few):
    assert categories.category_index(few, []).count() == 0
    assert categories.category_index(few.limit(0), ["one"]).count() == 0


def test_a_hundred_thousand_values_without_a_collect(spark, monkeypatch):
    df = spark.range(100_000).select(F.concat(F.lit("v"), F.col("id") * 7 % 100_000).alias("one"), F.lit("k").alias("two"))
    df = df.union(spark.range(50_000).select(F.lit("v0"), F.lit(None)))
    with monkeypatch.context() as patched:
        for name in ("collect", "toPandas", "toLocalIterator", "take"):
            patched.setattr(DataFrame, name, lambda *a, **k: pytest.fail("collected"))
        index = categories.category_index(df, ["one", "two"])
        rows = categories.with_positions(df, index, ["one", "two"])
    want = sorted(f"v{i}" for i in range(100_000))
    numbers = {r["value"]: r["position"] for r in index.filter("name = 'one'").collect()}
    assert numbers == {v: i for i, v in enumerate(want)}
    assert rows.count() == 150_000 and rows.filter("one_position IS NULL").count() == 0
    assert rows.filter("two_position IS NULL").count() == 50_000
    assert rows.filter("one = 'v0' AND one_position <> 0").count() == 0


def test_unseen_values_are_errors_only_where_asked(few):
    index = categories.category_index(few.filter("one = 'a' OR one = 'b'"), ["one"])
    rows = categories.with_positions(few, index, ["one"])
    got = {r["one"]: r["one_position"] for r in rows.collect()}
    assert got == {"a": 0, "b": 1, None: None, "c": None, "o'neil \\ é": None}
    strict = categories.strict_index("one", "one_position").alias("i")
    seen = rows.filter("one IS NULL OR one IN ('a', 'b')")
    assert {(r["one"], r["i"]) for r in seen.select("one", strict).collect()} == {("a", 0), ("b", 1), (None, 0)}
    with pytest.raises(PySparkException, match="unseen one: c"):
        rows.filter("one = 'c'").select(strict).collect()


def test_codes_leave_the_first_value_and_unseen_ones_to_the_last_place(few, tmp_path):
    index = categories.category_index(few.filter("one <> 'c'"), ["one", "two"])
    encoder = categories.CategoryEncoder(index, categories.category_sizes(index, ["one", "two"]))
    codes = lambda e: {(r["one"], r["two"], r["one_code"], r["two_code"]) for r in e.transform(few).collect()}
    assert {(one, code) for one, _, code, _ in codes(encoder)} == {("a", 2), ("b", 0), ("o'neil \\ é", 1), ("c", 2), (None, 2)}
    PipelineModel([encoder]).write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).stages[0]
    assert again.sizes == encoder.sizes and again.uid == encoder.uid and codes(again) == codes(encoder)
