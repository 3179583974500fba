"""Drift measures on small frames."""

import math

import numpy as np
import pytest

from holdfast.operators import drift


def scores(spark, values, model="m"):
    return spark.createDataFrame([(model, v) for v in values], "model_name string, churn_probability double")


def test_score_distance_is_that_of_the_binned_samples(spark):
    rng = np.random.default_rng(1)
    a, b = rng.beta(2, 3, 400).tolist(), rng.beta(3, 2, 300).tolist()
    got = drift.score_distance(
        drift.score_histogram(scores(spark, [*a, None])), drift.score_histogram(scores(spark, [*b, 1.0]))
    ).first()
    x, y = (np.floor(np.minimum(np.array(v), 0.9999) * 1000) for v in (a, [*b, 1.0]))
    want = max(abs((x <= k).mean() - (y <= k).mean()) for k in range(1000))
    assert got["ks"] == pytest.approx(want)


def test_equal_frames_do_not_drift(spark):
    h = drift.score_histogram(scores(spark, [0.1, 0.5, 0.9]))
    assert drift.score_distance(h, h).first()["ks"] == 0
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, None)], "t string, x int")
    f = drift.histogram(df, ["t"], drift.rank_edges(df, ["x"]))
    assert [r["psi"] for r in drift.stability_index(f, f).collect()] == [0, 0]


def test_stability_index_with_an_empty_bin_and_nulls(spark):
    one = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [(None,)], "t string")
    two = spark.createDataFrame([("a",)] * 5 + [("c",)] * 5, "t string")
    got = drift.stability_index(drift.histogram(one, ["t"], {}), drift.histogram(two, ["t"], {})).first()
    shares = [(0.6, 0.5), (0.3, 1e-4), (0.1, 1e-4), (1e-4, 0.5)]
    assert got["n_bins"] == 4 and got["psi"] == pytest.approx(sum((p - q) * math.log(p / q) for p, q in shares))


def test_parts_of_the_reference_add_up(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(100)], "t int, x int")
    edges = drift.rank_edges(df, ["x"], 4)
    assert [float(e) for e in edges["x"]] == [0, 24, 49, 74]
    whole = drift.histogram(df, ["t"], edges)
    parts = drift.merged(drift.histogram(df.filter("x < 30"), ["t"], edges), drift.histogram(df.filter("x >= 30"), ["t"], edges))
    assert sorted(whole.collect()) == sorted(parts.select(whole.columns).collect())


def test_rate_gap(spark):
    rows = [("m", "high", 0.9, 1), ("m", "high", 0.7, 0), ("m", "low", 0.1, 0), ("m", "low", None, 0)]
    df = spark.createDataFrame(rows, "model_name string, risk_tier string, churn_probability double, churned_actual int")
    got = {r["risk_tier"]: (r["n"], round(r["gap"], 9)) for r in drift.rate_gap(df).collect()}
    assert got == {"high": (2, 0.3), "low": (1, 0.1)}
