"""Data behind the report pages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.config import DEFAULT, Rules
from holdfast.functions.business import compact_number
from holdfast.plans.kpis import dbl

ALL = "All"
DISPLAY_COLUMNS = (
    "subscriber_id", "plan_tier", "region_code", "industry_name", "tenure_months",
    "engagement_score", "payment_failures_12m", "support_tickets_90d", "arr_usd",
    "churn_probability", "risk_tier",
)


def cohort_heatmap(retention: DataFrame, periods: list[int] | None = None) -> DataFrame:
    """One row per cohort, one column per tenure period.

    Without ``periods`` there is a column for each that occurs in the (aggregated) table.
    """
    if periods is None:
        rows = retention.select("period_bucket").distinct().orderBy("period_bucket").collect()
        periods = [r["period_bucket"] for r in rows]
    label = F.concat_ws("-", F.col("cohort_year").cast("string"), "cohort_quarter")
    wide = (
        retention.withColumn("cohort_label", label)
        .groupBy("cohort_label")
        .pivot("period_bucket", periods)
        .agg(F.round(F.avg("retention_pct"), 6))
    )
    return wide.select(
        "cohort_label", *[F.col(f"`{p}`").alias(f"period_{p}") for p in periods]
    ).orderBy("cohort_label")


def periods_without_gaps(retention: DataFrame) -> list[int]:
    """All periods up to the last one that occurs."""
    last = retention.agg(F.max("period_bucket").alias("last")).first()["last"]
    return [] if last is None else list(range(last + 1))


def watchlist_summary(watchlist: DataFrame) -> DataFrame:
    high = F.col("risk_tier") == "high"
    high_arr = F.coalesce(F.sum(F.when(high, F.col("arr_usd"))), F.lit(0.0))
    return watchlist.agg(
        F.count_if(high).alias("high_risk_accounts"),
        F.count_if(F.col("risk_tier") == "medium").alias("medium_risk_accounts"),
        high_arr.alias("arr_at_high_risk"),
    ).withColumn("arr_at_high_risk_text", compact_number(F.col("arr_at_high_risk"), "$"))


def filter_watchlist(
    watchlist: DataFrame,
    tiers: Iterable[str] | None = None,
    plans: Iterable[str] | None = None,
    search: str | None = None,
) -> DataFrame:
    """Tier and plan choice, and a regular expression on the account id."""
    out = watchlist
    if tiers is not None:
        out = out.filter(F.col("risk_tier").isin(*tiers))
    if plans is not None:
        out = out.filter(F.col("plan_tier").isin(*plans))
    if search:
        out = out.filter(F.coalesce(F.col("subscriber_id").rlike(search), F.lit(False)))
    return out


def page(filtered: DataFrame, number: int, rules: Rules = DEFAULT) -> DataFrame:
    """Rows of one page, by falling probability; percentages are brought to 0..1."""
    shown = [c for c in DISPLAY_COLUMNS if c in filtered.columns]
    rows = (
        filtered.orderBy(F.desc("churn_probability"), "subscriber_id", "model_name")
        .offset(rules.page_size * (number - 1))
        .limit(rules.page_size)
        .select(*shown)
    )
    return unit_probability(rows)


def unit_probability(rows: DataFrame) -> DataFrame:
    largest = rows.agg(F.max("churn_probability")).scalar()
    p = F.col("churn_probability")
    return rows.withColumn("churn_probability", F.when(largest > 1.0, p / 100.0).otherwise(p))


def page_count(filtered: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    n = F.count("*")
    pages = F.call_function("div", n - 1, F.lit(rules.page_size)) + 1
    return filtered.agg(n.alias("n_accounts"), F.greatest(F.lit(1), pages).alias("total_pages"))


def score_histogram(scored: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Counts of equal score bins on 0..1, by actual class."""
    bins = rules.histogram_bins
    position = F.floor(F.col("churn_probability") * bins).cast("int")
    return (
        scored.filter("churn_probability IS NOT NULL")
        .groupBy(
            F.greatest(F.lit(0), F.least(position, F.lit(bins - 1))).alias("bin"),
            "churned_actual",
        )
        .agg(F.count("*").alias("n"))
        .orderBy("bin", "churned_actual")
    )


def best_and_worst(comparison: DataFrame) -> DataFrame:
    """Model with the highest and the lowest value of each headline metric."""
    metrics = ("roc_auc", "pr_auc", "f1")
    cells = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]
    )
    by_name = F.struct("value", "model")
    return (
        comparison.select("model", F.inline(cells))
        .groupBy("metric")
        .agg(
            F.max_by("model", by_name).alias("best_model"),
            F.max("value").alias("best_value"),
            F.min_by("model", by_name).alias("worst_model"),
            F.min("value").alias("worst_value"),
        )
        .orderBy("metric")
    )


def narrative(headline: DataFrame) -> DataFrame:
    """Which statements the headline figures support."""
    rate, lost, total = F.col("churn_rate_pct"), F.col("lost_arr_usd"), F.col("total_arr_usd")
    return headline.select(
        "churn_rate_pct",
        F.when(rate > 20, "above").when(rate < 15, "below").otherwise("at median").alias("churn_band"),
        (F.col("avg_engagement_score") < 55).cast("int").alias("low_engagement"),
        compact_number(lost, "$").alias("lost_arr_text"),
        dbl(
            F.coalesce(
                F.round(
                    F.try_divide(
                        (lost * 100).cast("decimal(20,2)"), total.cast("decimal(18,2)")
                    ),
                    1,
                ),
                F.lit(0),
            )
        ).alias("pct_arr_lost"),
    )


def savings_estimate(headline: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    saved = F.col("lost_arr_usd").cast("decimal(20,2)") * F.lit(rules.save_rate)
    return headline.select(
        "lost_arr_usd",
        dbl(saved).alias("estimated_savings_usd"),
        compact_number(saved, "$").alias("estimated_savings_text"),
    )


def picker_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def apply_filters(
    df: DataFrame,
    plan: str = ALL,
    region: str = ALL,
    plan_col: str = "plan_tier",
    region_col: str = "region_code",
) -> DataFrame:
    """Equality filters; "All" or an absent column means no filter."""
    for column, choice in ((plan_col, plan), (region_col, region)):
        if choice != ALL and column in df.columns:
            df = df.filter(F.col(column) == choice)
    return df


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows, shown where a chart cannot be drawn."""
    return df.limit(rows)
