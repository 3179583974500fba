from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from holdfast.functions import business as b
from holdfast.functions import exact


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "num, den, places, want",
    [(1005, 1000, 2, "1.01"), (1, 3, 4, "0.3333"), (2, 3, 0, "1"), (-5, 2, 0, "-3"), (1, 0, 2, None)],
)
def test_ratio(spark, num, den, places, want):
    got = value(spark, exact.ratio(F.lit(num), F.lit(den), places))
    assert got == (None if want is None else D(want))


def test_clip_keeps_null(spark):
    assert value(spark, exact.clip(F.lit(None).cast("int"), 0, 4)) is None
    assert value(spark, exact.clip(F.lit(9), 0, 4)) == 4


def test_int_div_truncates(spark):
    assert value(spark, exact.int_div(F.lit(-7), 3)) == -2


@pytest.mark.parametrize("x", [-800.0, -1.0, 0.0, 1.0, 800.0])
def test_logistic_is_stable(spark, x):
    import math

    want = 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))
    assert value(spark, b.logistic(F.lit(x))) == pytest.approx(want)


@pytest.mark.parametrize(
    "score, segment, four",
    [(80, "Champion (80-100)", "Healthy (75-100)"), (79.9, "Engaged (60-79)", "Healthy (75-100)"),
     (40, "At Risk (40-59)", "At-Risk (25-49)"), (19, "Critical (<20)", "Critical (0-24)"),
     (None, "Critical (<20)", "Critical (0-24)")],
)
def test_engagement_bands(spark, score, segment, four):
    col = F.lit(score).cast("double")
    assert value(spark, b.band(col, b.ENGAGEMENT_SEGMENTS)) == segment
    assert value(spark, b.band(col, b.ENGAGEMENT_BANDS)) == four


def test_tenure_bands_are_ordered(spark):
    rows = spark.createDataFrame([(t,) for t in (0, 2, 3, 6, 12, 24)], "t int").select(
        b.band_number(F.col("t"), b.TENURE_BANDS).alias("n"), b.band(F.col("t"), b.TENURE_BANDS).alias("l")
    ).collect()
    assert [r["n"] for r in rows] == [1, 1, 2, 3, 4, 5]
    assert rows[-1]["l"] == "24+ months"


@pytest.mark.parametrize(
    "n, want",
    [(1_250_000, "$1.3M"), (999_999, "$1000.0K"), (1_000, "$1.0K"), (999, "$999"), (0, "$0"), (-2500, "$-2.5K")],
)
def test_compact_number(spark, n, want):
    assert value(spark, b.compact_number(F.lit(n), "$")) == want


@pytest.mark.parametrize("k, want", [(7, "SUB-000007"), (1_234_567, "SUB-1234567")])
def test_account_id_is_never_cut(spark, k, want):
    assert value(spark, b.account_id(F.lit(k))) == want


@pytest.mark.parametrize("days, want", [(0, 1), (10, 1), (46, 2), (365, 12)])
def test_tenure_months(spark, days, want):
    start = F.lit("2023-01-01").cast("date")
    assert value(spark, b.tenure_months(start, F.date_add(start, days))) == want


def test_nan_becomes_null(spark):
    assert value(spark, exact.not_nan(F.lit(float("nan")))) is None
    assert value(spark, exact.not_nan(F.lit(0.5))) == 0.5


def test_score_of_a_known_account(spark, accounts):
    """Recomputed by hand with the published coefficients."""
    import math

    df = accounts({"plan_tier": "enterprise", "billing_cycle": "annual", "industry_vertical": "E-commerce",
                   "support_tickets_90d": 4, "payment_failures_12m": 2, "feature_adoption_rate": None})
    logit = (0.88 - 1.2 * math.log(13) / math.log(37) - 1.5 * 0.65 - 0.8 * 3 / 11 - 0.6 - 0.7
             - 0.4 * 15 / 120 + 0.9 * 0.8 + 1.2 * 0.5 + 0.3)
    assert df.select(b.heuristic_churn_score()).first()[0] == round(1 / (1 + math.exp(-logit)), 4)
