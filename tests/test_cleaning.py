from datetime import date
from decimal import Decimal as D

import pytest

from holdfast.operators import cleaning


def rows(df):
    return {r["subscriber_id"]: r for r in df.collect()}


def steps(log):
    return {r["step"]: r for r in log.collect()}


def test_first_arrival_is_kept(accounts):
    raw = accounts(
        {"subscriber_id": "A", "seat_count": 9, "ingest_seq": 5},
        {"subscriber_id": "A", "seat_count": 4, "ingest_seq": 2},
        {"subscriber_id": "B"},
    )
    out, log = cleaning.clean(raw)
    assert {k: r["seat_count"] for k, r in rows(out).items()} == {"A": 4, "B": 3}
    assert steps(log)["dedup"]["n_affected"] == 1


def test_rows_without_arrival_number_come_last_but_are_not_lost(accounts):
    raw = accounts(
        {"subscriber_id": "A", "seat_count": 9, "ingest_seq": None},
        {"subscriber_id": "A", "seat_count": 4, "ingest_seq": 7},
        {"subscriber_id": "B", "seat_count": 5, "ingest_seq": None},
    )
    got = rows(cleaning.remove_duplicates(raw))
    assert {k: r["seat_count"] for k, r in got.items()} == {"A": 4, "B": 5}


def test_churn_before_start_is_reset_but_reason_stays(accounts):
    raw = accounts(
        {"churned": 1, "churn_date": date(2022, 12, 15), "churn_reason": "Feature gaps"},
        {"churned": 1, "churn_date": date(2023, 6, 1), "churn_reason": "Feature gaps"},
    )
    out, log = cleaning.clean(raw)
    bad, good = rows(out)["SUB-000000"], rows(out)["SUB-000001"]
    assert (bad["churned"], bad["churn_date"], bad["churn_reason"]) == (0, None, "Feature gaps")
    assert (good["churned"], good["churn_date"]) == (1, date(2023, 6, 1))
    assert steps(log)["dates"]["n_affected"] == 1


def test_low_fee_becomes_median_of_good_fees_of_the_tier(accounts):
    fees = ["-5", "10", "20", "25", "30"]
    raw = accounts(
        *[{"monthly_fee_per_seat": D(f)} for f in fees],
        {"plan_tier": "growth", "monthly_fee_per_seat": D("70")},
    )
    out, log = cleaning.clean(raw)
    got = rows(out)
    assert got["SUB-000000"]["monthly_fee_per_seat"] == D("22.500")
    assert got["SUB-000005"]["monthly_fee_per_seat"] == D("70.000")
    assert "Fee fix" in steps(log)["fees"]["message"]


def test_fees_above_the_maximum_and_null_fees_stay(accounts):
    raw = accounts({"monthly_fee_per_seat": D("5000")}, {"monthly_fee_per_seat": None})
    out, log = cleaning.clean(raw)
    assert rows(out)["SUB-000000"]["monthly_fee_per_seat"] == D("5000.000")
    assert rows(out)["SUB-000001"]["monthly_fee_per_seat"] is None
    assert "fees" not in steps(log)


def test_tier_with_only_bad_fees_has_no_median(accounts):
    raw = accounts(
        {"plan_tier": "growth", "monthly_fee_per_seat": D("1")},
        {"plan_tier": "starter"},
    )
    out, _ = cleaning.clean(raw)
    assert rows(out)["SUB-000000"]["monthly_fee_per_seat"] is None


def test_missing_scores_and_logins_are_imputed(accounts):
    raw = accounts(
        {"engagement_score": None},
        {"engagement_score": D("40.0")},
        {"engagement_score": D("51.0")},
        {"engagement_score": D("90.0"), "plan_tier": "growth", "monthly_logins_per_user": None},
        {"engagement_score": D("80.0"), "plan_tier": "growth", "monthly_logins_per_user": D("20")},
    )
    out, log = cleaning.clean(raw)
    got = rows(out)
    assert got["SUB-000000"]["engagement_score"] == D("45.50")
    assert got["SUB-000003"]["monthly_logins_per_user"] == D("15.0000")
    assert steps(log)["logins"]["message"].endswith("(15.00)")


def test_outliers_are_clipped_and_fractional_ticket_caps_truncated(accounts):
    tickets = [0, 1, 1, 2, 2, 3, 100]
    raw = accounts(*[{"support_tickets_90d": t} for t in tickets])
    out, log = cleaning.clean(raw)
    # quartiles 1 and 2.5, so the upper fence is 2.5 + 3 * 1.5 = 7
    assert max(r["support_tickets_90d"] for r in out.collect()) == 7
    assert steps(log)["cap_support_tickets_90d"]["n_affected"] == 1


def test_clean_input_logs_only_the_two_standing_steps(accounts):
    _, log = cleaning.clean(accounts({}, {}))
    assert set(steps(log)) == {"dedup", "types"}


def test_empty_input(accounts):
    raw = accounts({}).limit(0)
    out, log = cleaning.clean(raw)
    assert out.count() == 0
    assert set(steps(log)) == {"dedup", "types"}


@pytest.mark.parametrize("copies", [20_000])
def test_key_with_most_of_the_rows(spark, accounts, copies):
    from pyspark.sql import functions as F

    hot = accounts({"subscriber_id": "HOT"}).drop("ingest_seq").crossJoin(
        spark.range(copies).select(F.col("id").alias("ingest_seq"))
    )
    rest = accounts(*[{"subscriber_id": f"S{i}"} for i in range(50)])
    out = cleaning.remove_duplicates(hot.unionByName(rest))
    assert out.count() == 51
    assert out.filter("subscriber_id = 'HOT'").first()["ingest_seq"] == 0
