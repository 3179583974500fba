import pytest
from pyspark.sql import functions as F

from holdfast.plans import reports


@pytest.fixture
def watchlist(spark):
    return spark.range(60).select(
        F.concat(F.lit("SUB-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("subscriber_id"),
        F.when(F.col("id") % 2 == 0, "starter").otherwise("growth").alias("plan_tier"),
        F.when(F.col("id") < 20, "high").otherwise("medium").alias("risk_tier"),
        ((100 - F.col("id")) / 100.0).alias("churn_probability"),
        F.lit(1000.0).alias("arr_usd"),
        F.lit("m").alias("model_name"),
    )


def test_pages_partition_the_list(watchlist):
    seen = [r["subscriber_id"] for n in (1, 2, 3) for r in reports.page(watchlist, n).collect()]
    assert len(seen) == 60 and len(set(seen)) == 60
    assert reports.page(watchlist, 4).count() == 0
    assert reports.page_count(watchlist).first()["total_pages"] == 3
    assert reports.page_count(watchlist.limit(0)).first()["total_pages"] == 1


def test_percentages_become_fractions(watchlist):
    percent = watchlist.withColumn("churn_probability", F.col("churn_probability") * 100)
    assert reports.page(percent, 1).first()["churn_probability"] == pytest.approx(1.0)
    assert reports.page(watchlist, 1).first()["churn_probability"] == pytest.approx(1.0)


def test_filters(watchlist):
    out = reports.filter_watchlist(watchlist, ["high"], ["growth"], "00000[13]$")
    assert sorted(r["subscriber_id"] for r in out.collect()) == ["SUB-000001", "SUB-000003"]
    assert reports.filter_watchlist(watchlist).count() == 60


def test_summary(watchlist):
    row = reports.watchlist_summary(watchlist).first()
    assert tuple(row) == (20, 40, 20000.0, "$20.0K")
    empty = reports.watchlist_summary(watchlist.limit(0)).first()
    assert tuple(empty) == (0, 0, 0.0, "$0")


def test_histogram_clamps_the_ends(spark):
    df = spark.createDataFrame([(1.0, 1), (0.0, 0), (0.025, 0), (None, 0)], "churn_probability double, churned_actual int")
    assert [tuple(r) for r in reports.score_histogram(df).collect()] == [(0, 0, 1), (1, 0, 1), (39, 1, 1)]


@pytest.mark.parametrize(
    "rate, engagement, want", [(20.01, 54.9, ("above", 1)), (20.0, 55.0, ("at median", 0)), (14.99, 60.0, ("below", 0))]
)
def test_narrative_bands(spark, rate, engagement, want):
    df = spark.createDataFrame(
        [(rate, 250_000.0, 1_000_000.0, engagement)],
        "churn_rate_pct double, lost_arr_usd double, total_arr_usd double, avg_engagement_score double",
    )
    row = reports.narrative(df).first()
    assert (row["churn_band"], row["low_engagement"]) == want
    assert (row["lost_arr_text"], row["pct_arr_lost"]) == ("$250.0K", 25.0)
    assert reports.savings_estimate(df).first()["estimated_savings_usd"] == 75_000.0


def test_heatmap_columns_follow_the_data(spark):
    df = spark.createDataFrame(
        [(2023, "Q1", 0, 50.0), (2023, "Q1", 2, 25.0), (2023, "Q2", 0, 10.0)],
        "cohort_year int, cohort_quarter string, period_bucket int, retention_pct double",
    )
    out = reports.cohort_heatmap(df)
    assert out.columns == ["cohort_label", "period_0", "period_2"]
    assert [tuple(r) for r in out.collect()] == [("2023-Q1", 50.0, 25.0), ("2023-Q2", 10.0, None)]


def test_segment_filter_ignores_absent_columns(watchlist):
    assert reports.apply_filters(watchlist, plan="growth", region="EMEA").count() == 30
    assert reports.apply_filters(watchlist).count() == 60
    assert [r[0] for r in reports.picker_values(watchlist, "plan_tier").collect()] == ["growth", "starter"]


def test_best_and_worst(spark):
    df = spark.createDataFrame(
        [("a", 0.9, 0.1, 0.5), ("b", 0.6, 0.3, 0.4)], "model string, roc_auc double, pr_auc double, f1 double"
    )
    got = {r["metric"]: (r["best_model"], r["worst_model"]) for r in reports.best_and_worst(df).collect()}
    assert got == {"roc_auc": ("a", "b"), "pr_auc": ("b", "a"), "f1": ("a", "b")}


def test_preview(watchlist):
    assert reports.preview(watchlist).count() == 20
