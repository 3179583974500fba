import random

import pytest

from holdfast.operators.metrics import class_weights, compare_models, ranking_metrics, threshold_metrics

DDL = "model_name string, churn_probability double, churned_actual int"


def scored(spark, rows, name="m"):
    return spark.createDataFrame([(name, float(p), y) for p, y in rows], DDL)


def test_published_baseline_row(spark):
    confusion = [(1.0, 1)] * 70 + [(1.0, 0)] * 264 + [(0.0, 1)] * 255 + [(0.0, 0)] * 1111
    row = compare_models(scored(spark, confusion)).first()
    assert (row["roc_auc"], row["pr_auc"]) == (0.5117, 0.1951)
    assert (row["f1"], row["precision"], row["recall"]) == (0.2124, 0.2096, 0.2154)


def brute_force(rows):
    pos = [p for p, y in rows if y == 1]
    neg = [p for p, y in rows if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    steps, seen = 0.0, 0
    for t in sorted({p for p, _ in rows}, reverse=True):
        hits = sum(1 for p in pos if p >= t)
        steps += (hits - seen) / len(pos) * hits / sum(1 for p, _ in rows if p >= t)
        seen = hits
    return auc, steps


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("digits", [1, 6])
def test_ranking_against_brute_force(spark, seed, digits):
    rng = random.Random(seed)
    rows = [(round(rng.random() ** 3, digits), int(rng.random() < 0.3)) for _ in range(200)]
    row = ranking_metrics(scored(spark, rows)).first()
    auc, ap = brute_force(rows)
    assert row["roc_auc"] == pytest.approx(auc, abs=6e-5)
    assert row["pr_auc"] == pytest.approx(ap, abs=6e-5)


def test_scores_crowded_near_zero(spark):
    rng = random.Random(9)
    rows = [(rng.random() * 1e-7, int(rng.random() < 0.4)) for _ in range(150)] + [(0.0, 0), (1.0, 1)]
    row = ranking_metrics(scored(spark, rows)).first()
    auc, ap = brute_force(rows)
    assert row["roc_auc"] == pytest.approx(auc, abs=6e-5)
    assert row["pr_auc"] == pytest.approx(ap, abs=6e-5)


def test_undefined_measures(spark):
    only_negative = [(0.1, 0), (0.2, 0)]
    row = compare_models(scored(spark, only_negative)).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None
    assert (row["f1"], row["precision"], row["recall"]) == (0.0, 0.0, 0.0)


def test_threshold_is_inclusive(spark):
    row = threshold_metrics(scored(spark, [(0.4, 1), (0.3999, 1)])).first()
    assert (row["tp"], row["fn"]) == (1, 1)


def test_models_are_kept_apart(spark):
    both = scored(spark, [(0.9, 1), (0.1, 0)], "good").union(
        scored(spark, [(0.1, 1), (0.9, 0)], "bad")
    )
    got = {r["model_name"]: r["roc_auc"] for r in ranking_metrics(both).collect()}
    assert got == {"good": 1.0, "bad": 0.0}


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 8 + [(1,)] * 2, "churned int")
    got = {r["label"]: r for r in class_weights(df, "churned").collect()}
    assert got[1]["balanced_weight"] == 2.5 and got[1]["imbalance_weight"] == 4.0
    assert got[0]["balanced_weight"] == 0.625 and got[0]["imbalance_weight"] == 1.0
