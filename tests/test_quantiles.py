import random
from decimal import Decimal as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators.quantiles import exact_quantiles, tile_summary, value_counts


def frame(spark, values, group="g"):
    data = [(group, D(v).scaleb(-2)) for v in values]
    return spark.createDataFrame(data, "grp string, x decimal(12,2)")


CASES = {
    "single": [500],
    "pair": [100, 300],
    "ties": [100] * 40 + [200] * 3 + [900],
    "negative": [-500, -20, 0, 7, 7, 30000],
    "random": [random.Random(1).randint(-10_000, 5_000_000) for _ in range(501)],
}


@pytest.mark.parametrize("name", CASES)
def test_quantiles_match_linear_interpolation(spark, name):
    probs = ["0.0", "0.1", "0.25", "0.5", "0.75", "0.9", "1.0"]
    df = frame(spark, CASES[name])
    got = exact_quantiles(value_counts(df, [], "x"), [], probs).first()["quantiles"]
    for p in probs:
        want = np.quantile([v / 100 for v in CASES[name]], float(p))
        assert float(got[p]) == pytest.approx(want, abs=1e-4)


def test_quantiles_per_group(spark):
    df = frame(spark, [100, 200, 300], "a").union(frame(spark, [1000, 5000], "b"))
    got = exact_quantiles(value_counts(df, ["grp"], "x"), ["grp"], ["0.5"]).collect()
    assert {r["grp"]: r["quantiles"]["0.5"] for r in got} == {"a": D("2.0000"), "b": D("30.0000")}


def test_no_values_give_no_row(spark):
    assert exact_quantiles(value_counts(frame(spark, []), [], "x"), [], ["0.5"]).count() == 0


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("tiles", [3, 4, 7])
def test_tiles_match_ntile(spark, name, tiles):
    from pyspark.sql import Window

    df = frame(spark, CASES[name])
    want = (
        df.withColumn("tile", F.ntile(tiles).over(Window.partitionBy("grp").orderBy("x")))
        .groupBy("grp", "tile")
        .agg(
            F.count("*").alias("n"),
            F.min("x").alias("min_value"),
            F.max("x").alias("max_value"),
            F.sum("x").alias("sum_value"),
        )
    )
    got = tile_summary(df, ["grp"], "x", tiles).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_counts_are_computed_once(spark):
    """The bucket totals and the walk over the values share one shuffle."""
    df = frame(spark, CASES["random"])
    q = exact_quantiles(value_counts(df, ["grp"], "x"), ["grp"], ["0.5"])
    q.collect()
    assert "ReusedExchange" in q._jdf.queryExecution().executedPlan().toString()
