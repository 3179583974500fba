import pytest
from pyspark.sql import functions as F

from holdfast.operators.features import build_features, fit_preparation
from holdfast.plans import full_run, models
from holdfast.sources.accounts import MARKET_SEGMENTS
from holdfast.workspace import open_workspace

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frame(spark):
    """Features whose label follows engagement, so that a model can learn it."""
    w = open_workspace(spark, SF)
    return w.features.withColumn("churned", (F.col("engagement_score") < 30).cast("int"))


def quick_forest(train, rules=None):
    return models.train_forest(train, trees=5)


def quick_boosting(train, rules=None):
    return models.train_boosting(train, rounds=5)


def quick_perceptron(train, rules=None):
    return models.train_perceptron(train, epochs=30)


@pytest.mark.parametrize(
    "trainer", [models.train_logistic, quick_forest, quick_boosting, quick_perceptron]
)
def test_models_beat_chance_on_a_learnable_label(frame, trainer):
    scored = models.score(trainer(frame), frame)
    assert scored.columns == ["subscriber_id", "churn_probability", "churned_actual"]
    row = models.evaluate({"m": scored}).first()
    assert row["roc_auc"] > 0.8
    assert scored.filter("churn_probability NOT BETWEEN 0 AND 1").count() == 0


def test_saved_model_scores_the_same(frame, tmp_path):
    model = models.train_logistic(frame)
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    assert models.score(model, frame).exceptAll(models.score(again, frame)).count() == 0


def test_unseen_category_is_scored(frame):
    model = models.train_logistic(frame.filter("region != 'nam'"))
    other = frame.filter("region = 'nam'")
    assert models.score(model, other).count() == other.count()


def test_quoted_category_values(frame):
    odd = frame.withColumn(
        "industry_vertical",
        F.when(F.col("industry_vertical") == "building", "o'neil \\ co").otherwise(F.col("industry_vertical")),
    )
    prep = fit_preparation(odd)
    out = odd
    for s in models.preparation_stages(prep):
        out = s.transform(out)
    assert len(out.first()["features"]) == models.n_inputs(prep)
    name = next(n for n in prep.encoded_names() if "neil" in n)
    position = [*prep.scaled_names(), *prep.encoded_names()].index(name)
    from pyspark.ml.functions import vector_to_array

    hits = out.filter(vector_to_array(F.col("features"))[position] == 1.0)
    assert hits.count() == odd.filter("industry_vertical LIKE 'o%'").count() > 0


def test_open_vocabulary_is_trained_on(frame):
    copies = frame.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(1 + 4500 // max(1, frame.count())))))
    many = copies.withColumn("industry_vertical", F.concat_ws("_", F.lit("v"), "subscriber_id", "copy")).drop("copy")
    prep = fit_preparation(many)
    assert len(prep.categories["industry_vertical"]) == many.count() > 4000
    out = many
    for s in models.preparation_stages(prep):
        out = s.transform(out)
    values = prep.categories["industry_vertical"]
    row = out.filter(F.col("industry_vertical") == values[17]).first()
    assert out.columns == [*many.columns, "features"] and row["features"].size == models.n_inputs(prep)
    at = len(prep.scaled_names()) + len(prep.encoded_names()) - len(values) + 17
    assert row["features"][at] == 1.0 and row["features"].numNonzeros() < 60
    assert models.score(models.train_logistic(many), many).count() == many.count()


def test_class_weights_balance(frame):
    sums = {
        r["churned"]: r["w"]
        for r in models.with_class_weight(frame, fit_preparation(frame))
        .groupBy("churned")
        .agg(F.sum("weight").alias("w"))
        .collect()
    }
    assert sums[0] == pytest.approx(sums[1])


def test_copies_balance_the_classes_and_keep_all_rows(frame):
    out = models.balance_by_copies(frame, fit_preparation(frame))
    n = {r["churned"]: r["count"] for r in out.groupBy("churned").count().collect()}
    assert out.select("subscriber_id").distinct().count() == frame.count()
    assert 0.7 < n[1] / n[0] < 1.4


@pytest.mark.parametrize(
    "losses, patience, want",
    [([3, 2, 1], 2, None), ([3, 1, 2, 2, 0], 2, 4), ([1, 1, 1], 2, 3), ([2, 3, 1, 2, 2], 2, 5), ([], 1, None)],
)
def test_stopping_round(losses, patience, want):
    assert models.stopping_round(losses, patience) == want


def test_boosting_stops_when_the_held_out_loss_stops_falling(frame):
    noise = frame.withColumn("churned", (F.crc32("subscriber_id") % 2).cast("int"))
    model = models.train_boosting(noise, rounds=30, patience=3)
    assert model.stages[-1].getNumTrees < 30


def test_cross_validation_reports_mean_and_deviation(frame):
    row = models.cross_validate(frame, quick_forest).first()
    assert 0.5 < row["cv_roc_auc_mean"] <= 1 and row["cv_roc_auc_std"] >= 0


def test_whole_run(spark, tmp_path):
    w = open_workspace(spark, SF)
    out = str(tmp_path / "out")
    result = full_run.run(
        w.raw, out, industries=MARKET_SEGMENTS, trainers={"gradient_boost": quick_boosting}
    )
    assert {r["model"] for r in result.comparison.collect()} == {"baseline", "gradient_boost"}
    n = result.warehouse.fact.count()
    assert n == w.clean.count() == result.warehouse.predictions.count()
    checked = spark.read.csv(f"{out}/processed/model_validation", header=True).collect()
    folds = {r["model"]: r["cv_roc_auc_mean"] for r in checked}
    assert folds["baseline"] is None and 0 <= float(folds["gradient_boost"]) <= 1
    runs = spark.read.parquet(f"{out}/warehouse/fact_model_runs")
    assert runs.filter(F.col("data_hash") == result.data_hash).count() == 2
    assert build_features(w.clean, []).count() == n
