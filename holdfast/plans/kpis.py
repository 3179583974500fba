"""KPI views over the star schema.

Facts are aggregated by surrogate key before the dimension is joined, so the join
sees one row per key. Money and rates are exact until the final cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.config import DEFAULT, Rules
from holdfast.functions.business import (
    ENGAGEMENT_SEGMENTS,
    band,
    quarter_label,
    tenure_period,
)
from holdfast.functions.exact import mean, rate_pct
from holdfast.operators.warehouse import Warehouse


def dbl(c: Column) -> Column:
    return c.cast("double")


def churn_rate() -> Column:
    return dbl(rate_pct(F.sum("churned"), F.count("*")))


def revenue(where: Column | None = None) -> Column:
    amount = F.col("monthly_arr_usd")
    if where is not None:
        amount = F.when(where, amount).otherwise(0)
    return dbl(F.round(F.sum(amount), 0))


def headline(w: Warehouse) -> DataFrame:
    churned = F.col("churned")
    return w.fact.agg(
        F.count("*").alias("total_subscribers"),
        F.sum(F.when(churned == 0, 1).otherwise(0)).alias("active_subscribers"),
        F.sum("churned").alias("churned_subscribers"),
        churn_rate().alias("churn_rate_pct"),
        revenue().alias("total_arr_usd"),
        revenue(churned == 0).alias("active_arr_usd"),
        revenue(churned == 1).alias("lost_arr_usd"),
        dbl(mean("tenure_months", 1)).alias("avg_tenure_months"),
        dbl(mean("engagement_score", 1)).alias("avg_engagement_score"),
    )


def _by(w: Warehouse, key: str, *measures: Column) -> DataFrame:
    return w.fact.groupBy(key).agg(
        F.count("*").alias("n_subscribers"),
        F.sum("churned").alias("n_churned"),
        churn_rate().alias("churn_rate_pct"),
        *measures,
    )


def by_plan(w: Warehouse) -> DataFrame:
    grouped = _by(
        w,
        "plan_id",
        dbl(mean("monthly_fee_per_seat", 2)).alias("avg_monthly_fee"),
        dbl(mean("seat_count", 1)).alias("avg_seats"),
        revenue().alias("total_arr_usd"),
        dbl(mean("tenure_months", 1)).alias("avg_tenure_months"),
        dbl(mean("engagement_score", 1)).alias("avg_engagement"),
    )
    return (
        grouped.join(w.dims.plans, "plan_id")
        .select(
            "plan_tier", "tier_rank", "n_subscribers", "n_churned", "churn_rate_pct",
            "avg_monthly_fee", "avg_seats", "total_arr_usd", "avg_tenure_months",
            "avg_engagement",
        )
        .orderBy("tier_rank")
    )


def by_region(w: Warehouse) -> DataFrame:
    grouped = _by(
        w,
        "region_id",
        revenue().alias("total_arr_usd"),
        dbl(mean("engagement_score", 1)).alias("avg_engagement"),
    )
    return (
        grouped.join(w.dims.regions, "region_id")
        .select(
            "region_code", "region_name", "n_subscribers", "n_churned", "churn_rate_pct",
            "total_arr_usd", "avg_engagement",
        )
        .orderBy(F.desc("total_arr_usd"), "region_code")
    )


def by_channel(w: Warehouse) -> DataFrame:
    grouped = _by(
        w,
        "channel_id",
        dbl(mean("tenure_months", 1)).alias("avg_tenure_months"),
        dbl(mean("monthly_arr_usd", 0)).alias("avg_arr_usd"),
        dbl(mean("engagement_score", 1)).alias("avg_engagement"),
    )
    return (
        grouped.join(w.dims.channels, "channel_id")
        .select(
            "channel_code", "channel_type", "n_subscribers", "n_churned", "churn_rate_pct",
            "avg_tenure_months", "avg_arr_usd", "avg_engagement",
        )
        .orderBy("churn_rate_pct", "channel_code")
    )


def cohorts(fact: DataFrame) -> DataFrame:
    start = F.col("subscription_start_date")
    return fact.select(
        F.year(start).alias("cohort_year"),
        quarter_label(start).alias("cohort_quarter"),
        tenure_period(F.col("tenure_months")).alias("period_bucket"),
        "churned",
    )


def cohort_retention(w: Warehouse) -> DataFrame:
    """Active accounts per tenure period as a share of the whole cohort.

    One aggregation of the fact; the cohort size is the sum over its periods.
    """
    cohort = Window.partitionBy("cohort_year", "cohort_quarter")
    return (
        cohorts(w.fact)
        .groupBy("cohort_year", "cohort_quarter", "period_bucket")
        .agg(F.count("*").alias("n"), F.count_if(F.col("churned") == 0).alias("n_active"))
        .withColumn("cohort_size", F.sum("n").over(cohort))
        .filter("n_active > 0")
        .select(
            "cohort_year", "cohort_quarter", "period_bucket", "cohort_size", "n_active",
            dbl(rate_pct(F.col("n_active"), F.col("cohort_size"), 1)).alias("retention_pct"),
        )
        .orderBy("cohort_year", "cohort_quarter", "period_bucket")
    )


def cohort_retention_joined(w: Warehouse) -> DataFrame:
    """The same table as a join of two aggregates on the composite cohort key."""
    keys = ["cohort_year", "cohort_quarter"]
    accounts = cohorts(w.fact)
    base = accounts.groupBy(*keys).agg(F.count("*").alias("cohort_size"))
    activity = (
        accounts.filter("churned = 0")
        .groupBy(*keys, "period_bucket")
        .agg(F.count("*").alias("n_active"))
    )
    return (
        activity.join(base, keys)
        .select(
            *keys, "period_bucket", "cohort_size", "n_active",
            dbl(rate_pct(F.col("n_active"), F.col("cohort_size"), 1)).alias("retention_pct"),
        )
        .orderBy(*keys, "period_bucket")
    )


def flagged_accounts(w: Warehouse) -> DataFrame:
    """Active accounts with a high or medium prediction, of every model."""
    active = w.fact.filter("churned = 0").select(
        "subscriber_id", "plan_id", "region_id", "industry_id", "tenure_months",
        "engagement_score", "payment_failures_12m", "support_tickets_90d", "monthly_arr_usd",
    )
    flagged = w.predictions.filter(F.col("risk_tier").isin("high", "medium"))
    return (
        flagged.join(active, "subscriber_id")
        .join(w.dims.plans, "plan_id")
        .join(w.dims.regions, "region_id")
        .join(w.dims.industries, "industry_id")
        .select(
            "subscriber_id", "plan_tier", "region_code", "industry_name", "tenure_months",
            dbl(F.col("engagement_score")).alias("engagement_score"),
            "payment_failures_12m", "support_tickets_90d",
            dbl(F.round("monthly_arr_usd", 0)).alias("arr_usd"),
            "churn_probability", "risk_tier", "model_name", "predicted_at",
        )
    )


def watchlist(w: Warehouse, rules: Rules = DEFAULT) -> DataFrame:
    """The accounts most at risk, highest probability first."""
    return (
        flagged_accounts(w)
        .orderBy(F.desc("churn_probability"), "subscriber_id", "model_name")
        .limit(rules.watchlist_size)
    )


def engagement_segments(w: Warehouse) -> DataFrame:
    segment = band(F.col("engagement_score"), ENGAGEMENT_SEGMENTS)
    return (
        w.fact.groupBy(segment.alias("engagement_segment"))
        .agg(
            F.count("*").alias("n_subscribers"),
            F.sum("churned").alias("n_churned"),
            churn_rate().alias("churn_rate_pct"),
            dbl(mean("monthly_arr_usd", 0)).alias("avg_arr_usd"),
            dbl(mean("tenure_months", 1)).alias("avg_tenure"),
            F.min("engagement_score").alias("lowest"),
        )
        .orderBy(F.desc("lowest"))
        .drop("lowest")
    )


VIEWS = {
    "vw_kpi_headline": headline,
    "vw_kpi_by_plan": by_plan,
    "vw_kpi_by_region": by_region,
    "vw_kpi_by_channel": by_channel,
    "vw_cohort_retention": cohort_retention,
    "vw_risk_watchlist": flagged_accounts,
    "vw_engagement_segments": engagement_segments,
}


def register_views(w: Warehouse) -> None:
    """Tables and KPI views under their SQL names."""
    w.register_views()
    for name, view in VIEWS.items():
        view(w).createOrReplaceTempView(name)


def load_all(w: Warehouse) -> dict[str, DataFrame]:
    """The frames of the overview pages, lazily."""
    return {
        "headline": headline(w),
        "by_plan": by_plan(w),
        "by_region": by_region(w),
        "by_channel": by_channel(w),
        "risk_watchlist": flagged_accounts(w),
        "engagement_segments": engagement_segments(w),
        "cohort": cohort_retention(w),
    }
