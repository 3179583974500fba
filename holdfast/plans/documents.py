"""KPI variants over the flat documents: codes instead of keys, rates unrounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import DEFAULT, Rules
from holdfast.functions.business import ENGAGEMENT_BANDS, band
from holdfast.functions.exact import share
from holdfast.operators.warehouse import Dimensions
from holdfast.plans.kpis import cohorts, dbl


def _sum(col: str, where: Column | None = None) -> Column:
    value = F.col(col) if where is None else F.when(where, F.col(col)).otherwise(0)
    return dbl(F.coalesce(F.sum(value), F.lit(0)))


def _avg(col: str) -> Column:
    return F.try_divide(dbl(F.sum(col)), dbl(F.count(col)))


def headline(docs: DataFrame) -> DataFrame:
    churned = F.col("churned")
    return docs.agg(
        F.count("*").alias("total_subscribers"),
        F.count_if(churned == 0).alias("active_subscribers"),
        F.count_if(churned == 1).alias("churned_subscribers"),
        _sum("monthly_arr_usd").alias("total_arr_usd"),
        _sum("monthly_arr_usd", churned == 0).alias("active_arr_usd"),
        _sum("monthly_arr_usd", churned == 1).alias("lost_arr_usd"),
        _avg("tenure_months").alias("avg_tenure_months"),
        _avg("engagement_score").alias("avg_engagement_score"),
        share(F.count_if(churned == 1), F.count("*")).alias("churn_rate_pct"),
    )


def _by(docs: DataFrame, code: str, *measures: Column) -> DataFrame:
    return docs.groupBy(code).agg(
        F.count("*").alias("n_subscribers"),
        F.sum("churned").alias("n_churned"),
        _sum("monthly_arr_usd").alias("total_arr_usd"),
        share(F.sum("churned"), F.count("*")).alias("churn_rate_pct"),
        *measures,
    )


def by_plan(docs: DataFrame, dims: Dimensions) -> DataFrame:
    grouped = _by(docs, "plan_tier", _avg("engagement_score").alias("avg_engagement"))
    return grouped.join(
        dims.plans.select("plan_tier", "tier_rank"), "plan_tier", "left"
    ).orderBy("tier_rank")


def by_region(docs: DataFrame) -> DataFrame:
    grouped = _by(docs, "region_code", _avg("engagement_score").alias("avg_engagement"))
    return grouped.orderBy(F.desc("total_arr_usd"), "region_code")


def by_channel(docs: DataFrame, dims: Dimensions) -> DataFrame:
    return (
        _by(docs, "channel_code")
        .join(dims.channels.select("channel_code", "channel_type"), "channel_code", "left")
        .orderBy("churn_rate_pct", "channel_code")
    )


def engagement_bands(docs: DataFrame) -> DataFrame:
    """Four bands; a missing score sorts below all numbers, into the lowest band."""
    return (
        docs.groupBy(band(F.col("engagement_score"), ENGAGEMENT_BANDS).alias("engagement_segment"))
        .agg(
            F.count("*").alias("n_subscribers"),
            F.sum("churned").alias("n_churned"),
            _avg("monthly_arr_usd").alias("avg_arr_usd"),
            share(F.sum("churned"), F.count("*")).alias("churn_rate_pct"),
            _avg("engagement_score").alias("avg_score"),
        )
        .orderBy("avg_score")
        .drop("avg_score")
    )


def bucket_survival(docs: DataFrame) -> DataFrame:
    """Active share within each cohort and tenure period."""
    keys = ["cohort_year", "cohort_quarter", "period_bucket"]
    return (
        cohorts(docs)
        .groupBy(*keys)
        .agg(F.count("*").alias("n_total"), F.count_if(F.col("churned") == 0).alias("n_active"))
        .withColumn("retention_pct", share(F.col("n_active"), F.col("n_total")))
        .orderBy(*keys)
    )


def watchlist_single_model(
    docs: DataFrame,
    predictions: DataFrame,
    rules: Rules = DEFAULT,
    model_name: str | None = None,
) -> DataFrame:
    model = model_name or rules.primary_model
    flagged = predictions.filter(
        F.col("risk_tier").isin("high", "medium") & (F.col("model_name") == model)
    )
    return (
        flagged.join(docs.filter("churned = 0"), "subscriber_id")
        .select(
            "subscriber_id", "churn_probability", "risk_tier", "plan_tier", "region_code",
            dbl(F.col("monthly_arr_usd")).alias("arr_usd"),
            "tenure_months",
            dbl(F.col("engagement_score")).alias("engagement_score"),
            "predicted_at",
        )
        .orderBy(F.desc("churn_probability"), "subscriber_id")
        .limit(rules.watchlist_size)
    )
