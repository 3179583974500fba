from decimal import Decimal as D

import pytest
from pyspark.errors import PySparkException

from holdfast.operators import features


def test_columns_added_and_leakage_removed(accounts):
    out = features.build_features(accounts({}, {"engagement_score": D("10")}))
    assert not set(features.LEAKAGE_COLUMNS) & set(out.columns)
    assert {"subscriber_id", "churned"} <= set(out.columns)
    wanted = {*features.NUMERIC_FEATURES, *features.CATEGORICAL_FEATURES, *features.BINARY_FEATURES}
    assert wanted <= set(out.columns)


def test_lists_are_disjoint_and_described():
    lists = [features.NUMERIC_FEATURES, features.CATEGORICAL_FEATURES, features.BINARY_FEATURES]
    names = [n for part in lists for n in part]
    assert [len(p) for p in lists] == [19, 4, 6]
    assert len(names) == len(set(names))
    assert set(names) <= set(features.CATALOG) and len(features.CATALOG) == 30


def test_single_values(accounts):
    row = features.build_features(
        accounts(
            {
                "plan_tier": " Professional ", "billing_cycle": "annual", "support_tickets_90d": 9,
                "payment_failures_12m": 2, "engagement_score": D("20"),
                "feature_adoption_rate": None, "acquisition_channel": "referral",
            }
        ),
        edges=[D(0), D(50), D(100)],
    ).first()
    assert (row["plan_tier_enc"], row["plan_tier"]) == (2, "professional")
    assert row["billing_annual_flag"] == 1 and row["channel_is_referral"] == 1
    assert row["monthly_arr_usd"] == D("1079.64")
    assert row["risk_score_simple"] == pytest.approx(0.4 * 0.8 + 0.3 * 0.5 + 0.3)
    assert (row["is_high_ticket_user"], row["is_payment_delinquent"], row["is_low_adoption"]) == (1, 1, 0)
    assert row["seats_x_engagement"] == D("60.00")
    assert row["engagement_decile"] == 1


def test_unknown_plan_is_an_error(accounts):
    with pytest.raises(PySparkException, match="unknown plan tier"):
        features.build_features(accounts({"plan_tier": "gold"}), edges=[D(0), D(1)]).collect()


def test_deciles_keep_ties_together_and_close_on_the_right(accounts):
    scores = [10] * 5 + [20] * 5 + list(range(30, 40)) + [None]
    df = accounts(*[{"engagement_score": None if s is None else D(s)} for s in scores])
    edges = features.fit_decile_edges(df)
    out = features.build_features(df, edges).select("engagement_score", "engagement_decile")
    by_score = {}
    for r in out.collect():
        by_score.setdefault(r[0], set()).add(r[1])
    assert all(len(v) == 1 for v in by_score.values())
    assert by_score[None] == {None}
    assert by_score[D("10.00")] == {1}

    import pandas as pd

    want = pd.qcut([s for s in scores if s is not None], q=10, labels=False, duplicates="drop") + 1
    got = [by_score[D(s).quantize(D("0.01"))].copy().pop() for s in scores if s is not None]
    assert got == list(want)


def test_constant_score_has_no_decile(accounts):
    df = accounts({}, {})
    assert {r["engagement_decile"] for r in features.build_features(df).collect()} == {None}


def test_training_edges_apply_to_other_rows(accounts):
    train = accounts(*[{"engagement_score": D(s)} for s in range(0, 101, 10)])
    edges = features.fit_decile_edges(train)
    out = features.build_features(accounts({"engagement_score": D("-3")}, {"engagement_score": D("99")}), edges)
    assert sorted(r["engagement_decile"] for r in out.collect()) == [1, 10]


def test_scaling_uses_population_deviation_and_zero_for_missing(accounts):
    df = features.build_features(
        accounts({"feature_adoption_rate": None}, {"feature_adoption_rate": D("0.4")}), edges=[]
    )
    prep = features.fit_preparation(df)
    cols = features.scaled_columns(prep)
    got = sorted(r[0] for r in df.select(cols["feature_adoption_rate_scaled"]).collect())
    assert got == pytest.approx([-1.0, 1.0])
    # a constant column scales to zero
    assert df.select(cols["seat_count_scaled"]).first()[0] == 0.0


def test_one_hot_drops_the_first_and_ignores_unseen(accounts):
    df = features.build_features(
        accounts({"region": "NAM"}, {"region": "EMEA"}, {"region": "APAC"}), edges=[]
    )
    prep = features.fit_preparation(df.filter("region != 'nam'"))
    cols = features.one_hot_columns(prep)
    assert [c for c in cols if c.startswith("region")] == ["region_emea"]
    got = {r[0]: r[1] for r in df.select("region", cols["region_emea"]).collect()}
    assert got == {"nam": 0, "emea": 1, "apac": 0}


def test_label_index_is_alphabetical_and_strict(accounts):
    df = features.build_features(accounts({"region": "NAM"}, {"region": "EMEA"}), edges=[])
    prep = features.fit_preparation(df)
    got = {r[0]: r[1] for r in df.select("region", features.label_index_columns(prep)["region_index"]).collect()}
    assert got == {"emea": 0, "nam": 1}
    other = features.build_features(accounts({"region": "LATAM"}), edges=[])
    with pytest.raises(PySparkException, match="unseen region"):
        other.select(features.label_index_columns(prep)["region_index"]).collect()


def test_too_many_categories_are_refused(accounts):
    df = features.build_features(
        accounts(*[{"industry_vertical": f"i{i}"} for i in range(30)]), edges=[]
    )
    with pytest.raises(ValueError, match="category values"):
        features.fit_preparation(df, max_categories=3)


def test_names_of_similar_categories_stay_apart():
    names = features.one_hot_names("c", ["a", "b c", "b-c"])
    assert len(set(names)) == 2
