from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from holdfast.operators import constraints, keyed, warehouse as wh
from holdfast.plans import kpis, named_queries


def build(spark, accounts, *rows, scores=()):
    dims = wh.seed_dimensions(spark)
    fact = wh.load_subscribers(accounts(*rows), dims)
    scored = spark.createDataFrame(list(scores), "subscriber_id string, churn_probability double")
    preds = wh.prediction_rows(scored, "m", "r", F.lit("2024-01-01 00:00:00"))
    return wh.Warehouse(fact, dims, preds)


def test_seeds_keep_present_rows_and_add_missing_ones(spark):
    seeds = wh.seed_dimensions(spark)
    present = seeds.regions.filter("region_id = 2").withColumn("region_name", F.lit("renamed"))
    existing = wh.Dimensions(seeds.plans, present, seeds.channels, seeds.industries)
    again = wh.seed_dimensions(spark, existing)
    got = {r["region_code"]: r["region_name"] for r in again.regions.collect()}
    assert len(got) == 4 and got["EMEA"] == "renamed"
    assert [d.count() for d in again.by_key().values()] == [4, 4, 6, 8]


def test_seeds_over_other_ids_get_ids_of_their_own(spark, accounts):
    present = wh.seed_dimensions(spark, industries=("Mining", "Education", "Retail"))
    fact = wh.load_subscribers(accounts({"industry_vertical": "Mining"}, {}, {"industry_vertical": "Retail"}), present)
    dims = wh.seed_dimensions(spark, present)
    ids = {r["industry_name"]: r["industry_id"] for r in dims.industries.collect()}
    assert sorted(ids.values()) == list(range(1, 11))
    assert (ids["Mining"], ids["Education"], ids["Retail"], ids["Software & SaaS"]) == (1, 2, 3, 4)
    names = [r["industry_vertical"] for r in wh.denormalise(fact, dims).collect()]
    assert sorted(names) == ["Education", "Mining", "Retail"]


def test_last_of_a_batch_wins_in_load_and_upsert(spark, accounts):
    dims = wh.seed_dimensions(spark)
    first = wh.load_subscribers(accounts({}, {}), dims)
    batch = accounts(*[{"subscriber_id": "SUB-000001", "seat_count": n} for n in (7, 9, 8)])
    out = wh.load_subscribers(batch, dims, first, order="ingest_seq")
    assert {r["subscriber_id"]: r["seat_count"] for r in out.collect()} == {"SUB-000000": 3, "SUB-000001": 8}
    placed = batch.withColumn("ingest_seq", F.struct(F.lit("file").alias("file"), F.col("ingest_seq").alias("line")))
    loaded = keyed.upsert(accounts({}, {}).drop("ingest_seq"), placed, ["subscriber_id"], "ingest_seq")
    assert {r["subscriber_id"]: r["seat_count"] for r in loaded.collect()} == {"SUB-000000": 3, "SUB-000001": 8}


def test_lookup_folds_case_and_defaults_to_one(spark, accounts):
    dims = wh.seed_dimensions(spark)
    raw = accounts(
        {"plan_tier": "GROWTH", "region": "emea", "acquisition_channel": "Partner",
         "industry_vertical": "Education"},
        {"plan_tier": "gold", "region": "MARS", "acquisition_channel": "fax",
         "industry_vertical": "education"},
    )
    keys = ("plan_id", "region_id", "channel_id", "industry_id")
    got = {r["subscriber_id"]: tuple(r[k] for k in keys) for r in wh.lookup_keys(raw, dims).collect()}
    assert got == {"SUB-000000": (2, 2, 4, 8), "SUB-000001": (1, 1, 1, 1)}
    misses = {r["dimension"]: r["n_defaulted"] for r in constraints.lookup_misses(raw, dims).collect()}
    assert misses == {"plan": 1, "region": 1, "channel": 1, "industry": 1}


def test_load_replaces_and_is_idempotent(spark, accounts):
    dims = wh.seed_dimensions(spark)
    first = wh.load_subscribers(accounts({}, {}), dims)
    batch = accounts({"subscriber_id": "SUB-000001", "seat_count": 7}, {"subscriber_id": "NEW"})
    second = wh.load_subscribers(batch, dims, first)
    third = wh.load_subscribers(batch, dims, second)
    seats = {r["subscriber_id"]: r["seat_count"] for r in second.collect()}
    assert seats == {"SUB-000000": 3, "SUB-000001": 7, "NEW": 3}
    assert sorted(map(str, second.collect())) == sorted(map(str, third.collect()))
    assert second.filter("subscriber_id = 'NEW'").first()["monthly_arr_usd"] == D("1079.64")


def test_risk_tiers_and_decision_flag(spark):
    scored = spark.createDataFrame(
        [("a", 0.7), ("b", 0.6999), ("c", 0.4), ("d", 0.3999), ("e", float("nan"))],
        "subscriber_id string, churn_probability double",
    )
    rows = wh.prediction_rows(scored, "m", "r", F.lit("2024-01-01"), threshold=0.5)
    got = {r["subscriber_id"]: (r["risk_tier"], r["predicted_churned"]) for r in rows.collect()}
    assert got["a"] == ("high", 1) and got["b"] == ("medium", 1)
    assert got["c"] == ("medium", 0) and got["d"] == ("low", 0)
    assert rows.filter("subscriber_id = 'e'").first()["churn_probability"] is None


def test_repeated_predictions_multiply_revenue_until_upserted(spark, accounts):
    w = build(spark, accounts, {}, scores=[("SUB-000000", 0.8)])
    twice = wh.append_predictions(w.predictions, w.predictions)
    once = named_queries.arr_at_risk(w).first()
    doubled = named_queries.arr_at_risk(w.with_predictions(twice)).first()
    upserted = wh.load_predictions(w.predictions, w.predictions)
    assert (once["n_accounts"], once["arr_at_risk_usd"]) == (1, 1080.0)
    assert (doubled["n_accounts"], doubled["arr_at_risk_usd"]) == (1, 2159.0)
    assert named_queries.arr_at_risk(w.with_predictions(upserted)).first() == once
    assert kpis.flagged_accounts(w.with_predictions(twice)).count() == 2


def test_later_prediction_wins(spark):
    def at(day, p):
        df = spark.createDataFrame([("a", p)], "subscriber_id string, churn_probability double")
        return wh.prediction_rows(df, "m", day, F.lit(day))

    out = wh.load_predictions(at("2024-01-02", 0.1), at("2024-01-05", 0.9))
    assert [(r["run_id"], r["churn_probability"]) for r in out.collect()] == [("2024-01-02", 0.1)]


def test_empty_fact_gives_null_rates(spark, accounts):
    dims = wh.seed_dimensions(spark)
    fact = wh.load_subscribers(accounts({}).limit(0), dims)
    preds = wh.create_schema(spark)["fact_model_predictions"]
    w = wh.Warehouse(fact, dims, preds)
    row = kpis.headline(w).first()
    assert (row["total_subscribers"], row["churn_rate_pct"]) == (0, None)
    assert kpis.by_plan(w).count() == 0
    for query in named_queries.NAMED:
        assert named_queries.run_named_query(query, w).count() == 0


def test_constraints_find_what_is_wrong(spark, accounts):
    w = build(
        spark, accounts,
        {"monthly_fee_per_seat": D("-1"), "contract_months": 6, "churned": 2},
        {"engagement_score": D("101"), "billing_cycle": "weekly"},
        {"engagement_score": None},
        scores=[("SUB-000000", 1.5), ("GHOST", 0.2)],
    )
    found = {
        (r["table_name"], r["constraint_name"])
        for r in constraints.constraint_violations(w.fact, w.predictions).collect()
        if r["n_violations"]
    }
    assert found == {
        ("fact_subscribers", "check:monthly_fee_per_seat"),
        ("fact_subscribers", "check:contract_months"),
        ("fact_subscribers", "check:churned"),
        ("fact_subscribers", "check:engagement_score"),
        ("fact_subscribers", "check:billing_cycle"),
        ("fact_model_predictions", "check:churn_probability"),
    }
    lost = {r["reference"]: r["n_orphans"] for r in
            constraints.all_orphans(w.fact, w.predictions, w.dims.by_key()).collect()}
    assert lost.pop("fact_model_predictions.subscriber_id") == 1
    assert set(lost.values()) == {0}


def test_plan_sums_equal_the_headline(spark, accounts):
    rows = [{"plan_tier": t, "churned": c} for t in ("starter", "growth") for c in (0, 1, 1)]
    w = build(spark, accounts, *rows)
    got = constraints.reconcile(w.fact, accounts(*rows), kpis.by_plan(w)).collect()
    assert {(r["n"], r["n_churned"], r["churn_rate_pct"]) for r in got} == {(6, 4, 66.67)}


def test_running_revenue_ends_at_the_net_sum(spark, accounts):
    w = build(
        spark, accounts, {},
        {"churned": 1, "churn_date": date(2023, 3, 2)},
        {"churned": 1, "churn_date": None},
        {"churned": 0, "churn_date": date(2023, 4, 2)},
    )
    rows = named_queries.arr_running_total(w).collect()
    assert [r["event_month"] for r in rows] == ["2023-01", "2023-03"]
    assert rows[-1]["running_arr"] == pytest.approx(3 * 1079.64)
    union = named_queries.running_by_month(named_queries.monthly_arr_union(w.fact)).collect()
    assert union == rows


def test_cohort_forms_agree(spark, accounts):
    rows = [{"tenure_months": t, "churned": c} for t in (1, 2, 3, 7, 7) for c in (0, 0, 1)]
    w = build(spark, accounts, *rows)
    assert kpis.cohort_retention(w).collect() == kpis.cohort_retention_joined(w).collect()


def test_views_and_parameters(spark, accounts):
    w = build(spark, accounts, {}, {"plan_tier": "growth"})
    kpis.register_views(w)
    sql = "SELECT plan_tier FROM vw_kpi_by_plan WHERE tier_rank > ?"
    assert [r[0] for r in named_queries.query_sql(spark, sql, (1,)).collect()] == ["growth"]
    assert spark.sql("SELECT * FROM vw_risk_watchlist").count() == 0
    with pytest.raises(KeyError, match="no query named"):
        named_queries.run_named_query("q99", w)


def test_create_schema_is_repeatable(spark):
    first, second = wh.create_schema(spark), wh.create_schema(spark)
    assert {n: d.count() for n, d in first.items()} == {n: d.count() for n, d in second.items()}


def test_denormalised_documents_have_codes(spark, accounts):
    w = build(spark, accounts, {"region": "LATAM"})
    doc = wh.denormalise(w.fact, w.dims).first()
    assert (doc["region_code"], doc["channel_type"], doc["plan_tier"]) == ("LATAM", "inbound", "starter")
