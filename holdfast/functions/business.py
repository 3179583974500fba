"""Row-wise business expressions: periods, bands, tiers, labels and the heuristic score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.config import DEFAULT, HIGH_CHURN_INDUSTRIES, PLAN_TIERS, Rules


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"))


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def tenure_period(tenure: Column) -> Column:
    """Number of whole quarters of tenure."""
    return F.floor(tenure / F.lit(3)).cast("int")


# Bands as (lower bound, label), highest first; the last entry is the rest.
ENGAGEMENT_SEGMENTS = (
    (80, "Champion (80-100)"),
    (60, "Engaged (60-79)"),
    (40, "At Risk (40-59)"),
    (20, "Disengaged (20-39)"),
    (None, "Critical (<20)"),
)
ENGAGEMENT_BANDS = (
    (75, "Healthy (75-100)"),
    (50, "Moderate (50-74)"),
    (25, "At-Risk (25-49)"),
    (None, "Critical (0-24)"),
)
TENURE_BANDS = (
    (24, "24+ months"),
    (12, "12-24 months"),
    (6, "6-12 months"),
    (3, "3-6 months"),
    (None, "0-3 months"),
)


def band(col: Column, bands) -> Column:
    """Label of the first band whose lower bound is reached; null falls to the lowest band."""
    *bounded, (_, rest) = bands
    expr = F.lit(rest)
    for low, label in reversed(bounded):
        expr = F.when(col >= low, F.lit(label)).otherwise(expr)
    return expr


def band_number(col: Column, bands) -> Column:
    """Position of the band counted from the lowest, starting at 1."""
    *bounded, _ = bands
    expr = F.lit(1)
    for i, (low, _) in enumerate(reversed(bounded)):
        expr = F.when(col >= low, F.lit(i + 2)).otherwise(expr)
    return expr


def plan_ordinal(plan: Column) -> Column:
    """0 for the lowest tier up to 3; an unknown tier is an error."""
    code = F.lower(F.trim(plan))
    expr = F.raise_error(F.concat(F.lit("unknown plan tier: "), F.coalesce(code, F.lit("null"))))
    for i, tier in reversed(list(enumerate(PLAN_TIERS))):
        expr = F.when(code == tier, F.lit(i)).otherwise(expr)
    return expr.cast("int")


def annual_revenue(fee: Column, seats: Column) -> Column:
    return (fee * seats * F.lit(12)).cast("decimal(18,2)")


def tenure_months(start: Column, observed: Column) -> Column:
    return F.greatest(F.lit(1), F.round(F.datediff(observed, start) / F.lit(30.44)).cast("int"))


def risk_tier(prob: Column, rules: Rules = DEFAULT) -> Column:
    return (
        F.when(prob >= rules.high_risk, F.lit("high"))
        .when(prob >= rules.medium_risk, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def logistic(x: Column) -> Column:
    """Sigmoid of a double. exp may reach infinity, which gives 0, not an error."""
    return 1.0 / (1.0 + F.exp(-x))


def heuristic_churn_score() -> Column:
    """Churn probability from fixed coefficients; a missing signal counts as zero."""

    def num(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    # Intercept, coefficients and scales.
    logit = (
        F.lit(0.88)
        - 1.20 * (F.log1p(num("tenure_months")) / F.log1p(F.lit(36.0)))
        - 1.50 * (num("engagement_score") / 100.0)
        - 0.80 * (num("n_integrations") / 11.0)
        - 0.60 * (plan_ordinal(F.col("plan_tier")) / 3.0)
        - 0.70 * (F.col("billing_cycle") == "annual").cast("double")
        - 0.40 * (num("monthly_logins_per_user") / 120.0)
        - 0.50 * num("feature_adoption_rate")
        + 0.90 * (num("support_tickets_90d") / 5.0)
        + 1.20 * (num("payment_failures_12m") / 4.0)
        + F.when(F.col("industry_vertical").isin(*HIGH_CHURN_INDUSTRIES), 0.30).otherwise(-0.10)
    )
    return F.round(logistic(logit), 4)


def account_id(key: Column) -> Column:
    """Zero-padded to six digits; longer keys are kept whole."""
    digits = key.cast("string")
    padded = F.when(F.length(digits) >= 6, digits).otherwise(F.lpad(digits, 6, "0"))
    return F.concat(F.lit("SUB-"), padded)


def compact_number(n: Column, prefix: str = "", suffix: str = "", decimals: int = 0) -> Column:
    """12.3M / 4.5K style text."""

    def text(value: Column, unit: str, digits: int) -> Column:
        number = F.round(value.cast("decimal(24,6)"), digits).cast(f"decimal(24,{digits})")
        return F.concat(F.lit(prefix), number.cast("string"), F.lit(unit + suffix))

    return (
        F.when(F.abs(n) >= 1_000_000, text(n / F.lit(1_000_000), "M", 1))
        .when(F.abs(n) >= 1_000, text(n / F.lit(1_000), "K", 1))
        .otherwise(text(n, "", decimals))
    )
