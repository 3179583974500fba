"""Analytical questions, runnable by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.functions.business import TENURE_BANDS, band, band_number, month_label
from holdfast.functions.exact import mean, rate_pct, ratio
from holdfast.operators.quantiles import tile_summary
from holdfast.operators.warehouse import Warehouse
from holdfast.plans.kpis import churn_rate, dbl


def attrition_trend(w: Warehouse) -> DataFrame:
    """Churn rate per start quarter and its change; the windows run over quarters."""
    start = F.col("subscription_start_date")
    in_time = Window.orderBy("cohort_year", "cohort_q")
    rate = F.col("rate")
    return (
        w.fact.groupBy(F.year(start).alias("cohort_year"), F.quarter(start).alias("cohort_q"))
        .agg(
            F.count("*").alias("n"),
            F.sum("churned").alias("n_churned"),
            rate_pct(F.sum("churned"), F.count("*")).alias("rate"),
        )
        .withColumn("previous", F.lag(rate).over(in_time))
        .select(
            "cohort_year", "cohort_q", "n", "n_churned",
            dbl(rate).alias("churn_rate_pct"),
            dbl(F.col("previous")).alias("prev_period_rate"),
            dbl(rate - F.col("previous")).alias("period_change_pct"),
        )
        .orderBy("cohort_year", "cohort_q")
    )


def _exact_share():
    # Compared, not shown: enough digits to tell different shares apart.
    return F.try_divide(
        F.sum("churned").cast("decimal(18,0)"), F.count("*").cast("decimal(12,0)")
    )


def plan_retention_ranked(w: Warehouse) -> DataFrame:
    grouped = w.fact.groupBy("plan_id").agg(
        F.count("subscriber_id").alias("n_subscribers"),
        F.sum("churned").alias("n_churned"),
        churn_rate().alias("churn_rate_pct"),
        dbl(mean("tenure_months", 1)).alias("avg_tenure_months"),
        _exact_share().alias("churn_share"),
    )
    return (
        grouped.join(w.dims.plans, "plan_id")
        .withColumn("churn_rank", F.rank().over(Window.orderBy(F.desc("churn_share"))))
        .select(
            "plan_tier", "tier_rank", "n_subscribers", "n_churned", "churn_rate_pct",
            "churn_rank", "avg_tenure_months",
        )
        .orderBy(F.desc("churn_rate_pct"), "plan_tier")
    )


def arr_at_risk(w: Warehouse) -> DataFrame:
    """Revenue of flagged active accounts by tier, against all active revenue.

    Several predictions of one account count once in n_accounts but each adds its revenue.
    Predictions are counted per account and tier before the join, so both sides of the
    join hold an account once and the distinct count needs no shuffle of its own.
    """
    tiers = ("high", "medium")
    active = w.fact.filter("churned = 0").select("subscriber_id", "monthly_arr_usd")
    total = active.agg(F.sum("monthly_arr_usd")).scalar()
    flagged = (
        w.predictions.filter(F.col("risk_tier").isin(*tiers))
        .groupBy("subscriber_id")
        .agg(*[F.count_if(F.col("risk_tier") == t).alias(t) for t in tiers])
    )
    per_tier = F.array(
        *[F.struct(F.lit(t).alias("risk_tier"), F.col(t).alias("n")) for t in tiers]
    )
    return (
        flagged.join(active, "subscriber_id")
        .select("monthly_arr_usd", F.inline(per_tier))
        .filter("n > 0")
        .groupBy("risk_tier")
        .agg(
            F.count("*").alias("n_accounts"),
            F.sum(F.col("monthly_arr_usd") * F.col("n").cast("decimal(10,0)")).alias("arr"),
        )
        .select(
            "risk_tier", "n_accounts",
            dbl(F.round("arr", 0)).alias("arr_at_risk_usd"),
            dbl(
                F.round(
                    F.try_divide(
                        (F.col("arr") * 100).cast("decimal(24,2)"), total.cast("decimal(20,2)")
                    ),
                    2,
                )
            ).alias("pct_of_total_arr"),
        )
        .orderBy(F.desc("arr_at_risk_usd"), "risk_tier")
    )


def channel_retention_curve(w: Warehouse) -> DataFrame:
    tenure = F.col("tenure_months")
    return (
        w.fact.groupBy(
            "channel_id",
            band_number(tenure, TENURE_BANDS).alias("bucket_no"),
            band(tenure, TENURE_BANDS).alias("tenure_bucket"),
        )
        .agg(
            F.count("*").alias("n"),
            F.sum("churned").alias("n_churned"),
            churn_rate().alias("churn_rate_pct"),
        )
        .join(w.dims.channels, "channel_id")
        .orderBy("channel_code", "bucket_no")
        .select("channel_code", "tenure_bucket", "n", "n_churned", "churn_rate_pct")
    )


def monthly_arr_events(accounts: DataFrame) -> DataFrame:
    """Revenue gained by start month and lost by churn month, from one read.

    Each account becomes its start event and, when it churned, its end event.
    """
    amount, nothing = F.col("monthly_arr_usd"), F.lit(0).cast("decimal(18,2)")

    def event(day: str, added, lost):
        return F.struct(
            month_label(F.col(day)).alias("event_month"),
            added.alias("arr_added"),
            lost.alias("arr_lost"),
        )

    ended = (F.col("churned") == 1) & F.col("churn_date").isNotNull()
    events = F.array_compact(
        F.array(
            event("subscription_start_date", amount, nothing),
            F.when(ended, event("churn_date", nothing, amount)),
        )
    )
    return accounts.select(F.inline(events))


def monthly_arr_union(accounts: DataFrame) -> DataFrame:
    """The same events as the union of two monthly aggregates."""
    nothing = F.lit(0).cast("decimal(28,2)")
    added = accounts.groupBy(
        month_label(F.col("subscription_start_date")).alias("event_month")
    ).agg(F.sum("monthly_arr_usd").alias("arr_added"), nothing.alias("arr_lost"))
    lost = (
        accounts.filter("churned = 1 AND churn_date IS NOT NULL")
        .groupBy(month_label(F.col("churn_date")).alias("event_month"))
        .agg(nothing.alias("arr_added"), F.sum("monthly_arr_usd").alias("arr_lost"))
    )
    return added.unionByName(lost)


def running_by_month(events: DataFrame, net_name: str = "net_arr_change") -> DataFrame:
    """Sums per month and the running net total; the window runs over months."""
    monthly = events.groupBy("event_month").agg(
        F.sum("arr_added").alias("arr_added"), F.sum("arr_lost").alias("arr_lost")
    )
    so_far = Window.orderBy("event_month").rowsBetween(Window.unboundedPreceding, 0)
    net = F.col("arr_added") - F.col("arr_lost")
    return (
        monthly.withColumn("running", F.sum(net).over(so_far))
        .select(
            "event_month",
            dbl(F.col("arr_added")).alias("arr_added"),
            dbl(F.col("arr_lost")).alias("arr_lost"),
            dbl(net).alias(net_name),
            dbl(F.col("running")).alias("running_arr"),
        )
        .orderBy("event_month")
    )


def arr_running_total(w: Warehouse) -> DataFrame:
    return running_by_month(monthly_arr_events(w.fact))


def industry_churn_arr(w: Warehouse) -> DataFrame:
    lost = F.sum(F.when(F.col("churned") == 1, F.col("monthly_arr_usd")).otherwise(0))
    grouped = w.fact.groupBy("industry_id").agg(
        F.count("*").alias("n_subscribers"),
        F.sum("churned").alias("n_churned"),
        churn_rate().alias("churn_rate_pct"),
        lost.alias("lost"),
        _exact_share().alias("churn_share"),
    )
    return (
        grouped.join(w.dims.industries, "industry_id")
        .select(
            "industry_name", "n_subscribers", "n_churned", "churn_rate_pct",
            dbl(F.round("lost", 0)).alias("arr_lost_usd"),
            F.rank().over(Window.orderBy(F.desc("churn_share"))).alias("churn_rank"),
            F.rank().over(Window.orderBy(F.desc("lost"))).alias("arr_loss_rank"),
        )
        .orderBy(F.desc("arr_lost_usd"), "industry_name")
    )


def engagement_quartiles(w: Warehouse) -> DataFrame:
    """Score range of the four equal slices of each plan."""
    scored = w.fact.filter("engagement_score IS NOT NULL AND plan_id IS NOT NULL").select(
        "plan_id", "engagement_score"
    )
    return (
        tile_summary(scored, ["plan_id"], "engagement_score", 4)
        .join(w.dims.plans, "plan_id")
        .select(
            "plan_tier",
            F.col("tile").alias("quartile"),
            "n",
            dbl(F.round("min_value", 1)).alias("min_score"),
            dbl(F.round("max_value", 1)).alias("max_score"),
            dbl(ratio(F.col("sum_value"), F.col("n"), 1)).alias("avg_score"),
        )
        .orderBy("plan_tier", "quartile")
    )


def cohort_six_month(w: Warehouse) -> DataFrame:
    start = F.col("subscription_start_date")
    kept = F.count_if((F.col("tenure_months") >= 6) & (F.col("churned") == 0))
    return (
        w.fact.groupBy(F.year(start).alias("start_year"), F.month(start).alias("start_month"))
        .agg(F.count("*").alias("cohort_size"), kept.alias("still_active_6m"))
        .withColumn(
            "six_month_retention_pct",
            dbl(rate_pct(F.col("still_active_6m"), F.col("cohort_size"), 1)),
        )
        .orderBy("start_year", "start_month")
    )


NAMED: dict[str, Callable[[Warehouse], DataFrame]] = {
    "q01_attrition_trend": attrition_trend,
    "q02_plan_retention_ranked": plan_retention_ranked,
    "q03_arr_at_risk": arr_at_risk,
    "q04_channel_retention_curve": channel_retention_curve,
    "q05_arr_running_total": arr_running_total,
    "q06_industry_churn_arr": industry_churn_arr,
    "q07_engagement_quartiles": engagement_quartiles,
    "q08_cohort_six_month": cohort_six_month,
}


def run_named_query(name: str, w: Warehouse) -> DataFrame:
    if name not in NAMED:
        raise KeyError(f"no query named {name}; known: {', '.join(sorted(NAMED))}")
    return NAMED[name](w)


def query_sql(spark: SparkSession, sql: str, params: tuple = ()) -> DataFrame:
    """SQL text with positional ``?`` parameters over the registered views."""
    return spark.sql(sql, args=list(params)) if params else spark.sql(sql)
