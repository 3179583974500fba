from datetime import date
from decimal import Decimal as D

from holdfast.operators import quality


def test_each_kind_of_violation(accounts):
    raw = accounts(
        {"subscriber_id": "A"},
        {"subscriber_id": "A", "plan_tier": "GROWTH"},
        {"plan_tier": "gold", "region": None},
        {"monthly_fee_per_seat": D("1000"), "seat_count": 501},
        {"monthly_fee_per_seat": D("9.98"), "tenure_months": -1},
        {"engagement_score": None, "feature_adoption_rate": D("1.001")},
        {"churned": 3},
    )
    got = {(r["column_name"], r["rule"]): r["n_violations"] for r in quality.violations(raw).collect()}
    assert got == {
        ("subscriber_id", "duplicates"): 1,
        ("plan_tier", "not_allowed"): 1,
        ("region", "nulls_found"): 1,
        ("monthly_fee_per_seat", "above_maximum"): 1,
        ("monthly_fee_per_seat", "below_minimum"): 1,
        ("seat_count", "above_maximum"): 1,
        ("tenure_months", "below_minimum"): 1,
        ("feature_adoption_rate", "above_maximum"): 1,
        ("churned", "not_allowed"): 1,
    }


def test_header_counts_null_keys_as_repeats(accounts):
    raw = accounts(
        {"subscriber_id": None}, {"subscriber_id": None}, {"subscriber_id": "A"},
        {"churned": 1, "churn_date": date(2020, 1, 1)},
    )
    row = quality.header(raw).first()
    assert (row["n_rows"], row["n_duplicates"], row["pct_duplicates"], row["n_bad_dates"]) == (4, 1, 25.0, 1)
    # within the column rule, nulls are no duplicates
    found = {r["rule"] for r in quality.violations(raw).collect() if r["column_name"] == "subscriber_id"}
    assert found == {"nulls_found"}


def test_text_numbers_are_coerced(spark):
    df = spark.createDataFrame([("5",), ("x",), ("900",)], "seat_count string")
    got = {(r["column_name"], r["rule"]): r["n_violations"] for r in quality.violations(df).collect()}
    assert got == {("seat_count", "above_maximum"): 1}


def test_report_and_text(accounts):
    raw = accounts({"subscriber_id": "A"}, {"subscriber_id": "A"}).drop("region")
    row = quality.report(raw).first()
    assert "Expected column 'region' is missing" in row["global_issues"]
    assert "1 duplicate subscriber_id values" in row["global_issues"]
    ids = next(c for c in row["columns"] if c["column_name"] == "subscriber_id")
    assert list(ids["issues"]) == ["1 duplicate values"] and ids["n_total"] == 2
    lines = [r["value"] for r in quality.report_lines(quality.report(raw)).orderBy("line_no").collect()]
    assert lines[0] == "Rows: 2 | Duplicates: 1 (50.0%) | Total issues: 3"
    assert "  subscriber_id (null: 0.0%):" in lines


def test_empty_input(accounts):
    row = quality.report(accounts({}).limit(0)).first()
    assert (row["n_rows"], row["n_duplicates"], row["pct_duplicates"]) == (0, 0, None)


def test_profile_shuffles_the_accounts_once(accounts):
    df = quality.profile(accounts({}, {}))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 2
