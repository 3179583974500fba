"""Exact selection by splitters, against sorted lists."""

import random
from decimal import Decimal as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import selection
from holdfast.operators.selection import quantiles, values_at_ranks

random.seed(3)
CASES = {
    "single": [500],
    "ties": [100] * 400 + [200] * 3 + [900],
    "within one percent": [1_000_000 + k for k in range(3000)],
    "negative and wide": [-5_000_000_000, -20, 0, 7, 7, 30000, 9_000_000_000],
    "random": [random.randint(-10_000, 5_000_000) for _ in range(2501)],
    "beyond the precision of a double": [10**18 + k for k in (0, 1, 2, 3, 5, 8, 13, 100, 101)],
    "half equal": [77] * 1500 + [random.randint(0, 10**9) for _ in range(1500)],
}


def frame(spark, values, group="g"):
    return spark.createDataFrame([(group, D(v).scaleb(-2)) for v in values] + [(group, None)], "grp string, x decimal(20,2)")


@pytest.mark.parametrize("most", [1_000_000, 5])
@pytest.mark.parametrize("name", CASES)
def test_every_asked_rank(spark, name, most):
    values = sorted(CASES[name])
    asked = sorted({0, len(values) // 3, len(values) // 2, len(values) - 1})
    ranks = F.array(*[F.lit(r).cast("bigint") for r in (*asked, len(values))])  # the last one is beyond
    got = values_at_ranks(frame(spark, CASES[name]), ["grp"], "x", ranks, splitters=8, most_values=most).collect()
    assert {r["rank"]: r["at_rank"] for r in got} == {r: D(values[r]).scaleb(-2) for r in asked}
    assert {r["total"] for r in got} == {len(values)}


@pytest.mark.parametrize("name", [name for name in CASES if "precision" not in name])
def test_quantiles_match_linear_interpolation(spark, name):
    probs = ["0.0", "0.1", "0.25", "0.5", "0.9", "1.0"]
    got = quantiles(frame(spark, CASES[name]), [], "x", probs).first()["quantiles"]
    for p in probs:
        want = np.quantile([v / 100 for v in CASES[name]], float(p))
        assert float(got[p]) == pytest.approx(want, rel=1e-9, abs=1e-4)


def test_groups_and_null_groups(spark):
    df = frame(spark, [100, 200, 300], "a").union(frame(spark, [1000, 5000], None)).union(frame(spark, [], "none"))
    got = quantiles(df, ["grp"], "x", ["0.5"]).collect()
    assert {r["grp"]: r["quantiles"]["0.5"] for r in got} == {"a": D("2.0000"), None: D("30.0000")}
    assert quantiles(df.filter("x > 99999"), [], "x", ["0.5"]).count() == 0


def test_large_buckets_are_split_until_they_are_small(spark, monkeypatch):
    levels = []
    placed = selection._placed
    monkeypatch.setattr(selection, "_placed", lambda rows, keys, level, n: levels.append(level) or placed(rows, keys, level, n))
    df = spark.range(4000).select(F.lit("g").alias("grp"), (F.col("id") + 10**12).alias("x"))
    got = values_at_ranks(df, ["grp"], "x", F.array(F.lit(1234)), splitters=4, most_values=50).first()
    assert got["at_rank"] == 10**12 + 1234 and levels == list(range(len(levels))) and 1 < len(levels) < 5


def test_only_wanted_buckets_are_read_on(spark, tmp_path, monkeypatch):
    spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("x")).write.parquet(str(tmp_path / "t"))
    joins, join = [], selection.join_own_aggregate
    monkeypatch.setattr(selection, "join_own_aggregate", lambda *a: joins.append(join(*a)) or joins[-1])
    table = spark.read.parquet(str(tmp_path / "t"))
    found = values_at_ranks(table, [], "x", F.array(F.lit(50_000)), most_values=5_000)
    assert found.count() == 1
    kept, _ = joins  # the rows of the wanted buckets; their counts
    assert 0 < kept.count() < 10_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
