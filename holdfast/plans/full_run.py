"""The whole job: raw accounts to warehouse, models, predictions and reports.

Each step writes its table below one output folder and hands on a scan of what it
wrote, so no step is computed twice and a lost executor costs only running tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.config import DEFAULT, Rules
from holdfast.operators import cleaning, quality
from holdfast.operators.features import (
    LABEL,
    build_features,
    fit_decile_edges,
    with_comments,
)
from holdfast.operators.fingerprint import fingerprint
from holdfast.operators.splits import baseline_probability, exact_split
from holdfast.operators.warehouse import (
    INDUSTRY_NAMES,
    Warehouse,
    empty_table,
    load_predictions,
    load_subscribers,
    prediction_rows,
    seed_dimensions,
)
from holdfast.plans import models
from holdfast.schemas import FACT_MODEL_RUNS, FACT_PREDICTIONS, FACT_SUBSCRIBERS
from holdfast.session import stage
from holdfast.sources import files, versions


@dataclass
class RunResult:
    warehouse: Warehouse
    comparison: DataFrame
    data_hash: str


def step_validate(raw: DataFrame, out: str, rules: Rules = DEFAULT) -> None:
    files.write_quality_report(
        quality.report(raw, rules), f"{out}/interim/quality_report", f"{out}/interim/quality_text"
    )


def step_clean(raw: DataFrame, out: str, rules: Rules = DEFAULT) -> DataFrame:
    cleaned, log = cleaning.clean(raw, rules)
    path = f"{out}/interim/subscribers_cleaned"
    files.write_clean(cleaned, log, path, f"{out}/interim/cleaning_log")
    return files.read_clean(raw.sparkSession, path)


def _before(spark: SparkSession, previous: str | None, name: str, ddl: str) -> DataFrame | None:
    """A warehouse table of the version before."""
    return None if previous is None else spark.read.schema(ddl).parquet(f"{previous}/warehouse/{name}")


def step_warehouse(
    cleaned: DataFrame, out: str, industries: tuple[str, ...] = INDUSTRY_NAMES, previous: str | None = None
) -> Warehouse:
    """Accounts of the version before stay unless they are loaded anew."""
    spark = cleaned.sparkSession
    dims = seed_dimensions(spark, industries=industries)
    fact = load_subscribers(cleaned, dims, _before(spark, previous, "fact_subscribers", FACT_SUBSCRIBERS))
    path = f"{out}/warehouse/fact_subscribers"
    files.write_table(fact, path)
    stored = spark.read.schema(fact.schema).parquet(path)
    return Warehouse(stored, dims, empty_table(spark, FACT_PREDICTIONS))


def step_features(cleaned: DataFrame, out: str, rules: Rules = DEFAULT) -> DataFrame:
    """Feature table with its part in ``split``; decile edges come from the training rows."""
    parts = stage(exact_split(cleaned, "subscriber_id", LABEL, rules), "parts")
    edges = fit_decile_edges(parts.filter("split = 'train'"))
    path = f"{out}/processed/features"
    files.write_splits(with_comments(build_features(parts, edges)), path)
    return files.read_features(cleaned.sparkSession, path)


def _baseline(rows: DataFrame, train: DataFrame, rules: Rules) -> DataFrame:
    return baseline_probability(rows, train, models.KEY, LABEL, rules).select(
        models.KEY, "churn_probability", F.col(LABEL).alias("churned_actual")
    )


def step_train(
    features: DataFrame,
    out: str,
    rules: Rules = DEFAULT,
    trainers: dict[str, Callable[..., PipelineModel]] | None = None,
    cross_validation: bool = True,
) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Fits on train, checks on val and by folds, evaluates once on test.

    Returns the test comparison and the models.
    """
    trainers = models.TRAINERS if trainers is None else trainers
    train, val, test = (
        features.filter(F.col("split") == part).drop("split") for part in ("train", "val", "test")
    )
    fitted = {name: trainer(train, rules) for name, trainer in trainers.items()}
    for name, model in fitted.items():
        models.save_model(model, f"{out}/models/{name}")

    def score_all(rows: DataFrame) -> DataFrame:
        scored = {"baseline": _baseline(rows, train, rules)}
        scored |= {name: models.score(model, rows) for name, model in fitted.items()}
        return models.stack(scored)

    validation = models.compare_models(score_all(val), rules)
    if cross_validation and trainers:
        folds = [
            models.cross_validate(train, trainer, rules).withColumn("model", F.lit(name))
            for name, trainer in trainers.items()
        ]
        validation = validation.join(reduce(DataFrame.unionByName, folds), "model", "left")
    files.write_comparison(validation, f"{out}/processed/model_validation")

    predictions = f"{out}/processed/predictions"
    files.write_predictions(score_all(test), predictions)
    comparison = f"{out}/processed/model_comparison"
    files.write_comparison(
        models.compare_models(features.sparkSession.read.parquet(predictions), rules), comparison
    )
    return files.read_comparison(features.sparkSession, comparison), fitted


def step_predict(
    model: PipelineModel,
    features: DataFrame,
    warehouse: Warehouse,
    out: str,
    predicted_at: Column,
    model_name: str,
    rules: Rules = DEFAULT,
    previous: str | None = None,
) -> Warehouse:
    """Scores every account and loads the predictions of the primary model next to earlier ones."""
    spark = features.sparkSession
    scored = models.score(model, features.drop("split"))
    rows = load_predictions(
        prediction_rows(scored, model_name, "latest", predicted_at, rules),
        _before(spark, previous, "fact_model_predictions", FACT_PREDICTIONS),
    )
    path = f"{out}/warehouse/fact_model_predictions"
    files.write_table(rows, path)
    return warehouse.with_predictions(spark.read.schema(rows.schema).parquet(path))


def run(
    raw: DataFrame,
    out: str,
    rules: Rules = DEFAULT,
    industries: tuple[str, ...] = INDUSTRY_NAMES,
    trainers: dict[str, Callable[..., PipelineModel]] | None = None,
    at: Column | None = None,
    cross_validation: bool = True,
    previous: str | None = None,
) -> RunResult:
    """Writes everything below ``out``, a folder without a run; ``previous`` is that of the version before."""
    spark: SparkSession = raw.sparkSession
    if at is None:
        # One instant for the whole run, not one per query.
        at = F.lit(spark.range(1).select(F.current_timestamp()).first()[0])
    step_validate(raw, out, rules)
    cleaned = step_clean(raw, out, rules)
    warehouse = step_warehouse(cleaned, out, industries, previous)
    features = step_features(cleaned, out, rules)
    data_hash = fingerprint(cleaned).first()["data_hash"]
    comparison, fitted = step_train(features, out, rules, trainers, cross_validation)
    sizes = features.groupBy("split").count().collect()
    n = {r["split"]: r["count"] for r in sizes}
    record = models.run_record(
        comparison, at, data_hash, n.get("train", 0), n.get("test", 0), f"{out}/models"
    )
    earlier = _before(spark, previous, "fact_model_runs", FACT_MODEL_RUNS)
    record = record if earlier is None else earlier.unionByName(record.select(*earlier.columns))
    files.append_run(record, f"{out}/warehouse/fact_model_runs")
    primary = rules.primary_model if rules.primary_model in fitted else next(iter(fitted))
    warehouse = step_predict(
        fitted[primary], features, warehouse, out, at, primary, rules, previous
    )
    return RunResult(warehouse, comparison, data_hash)


def run_again(raw: DataFrame, root: str, **settings) -> RunResult:
    """One more run on a versioned output: loads on top of the current version, then becomes it.

    ``settings`` are those of ``run``. A run that fails leaves the current version as it is.
    """
    return versions.write_version(
        raw.sparkSession, root, lambda out, previous: run(raw, out, previous=previous, **settings)
    )


def open_version(spark: SparkSession, root: str, industries: tuple[str, ...] = INDUSTRY_NAMES) -> Warehouse | None:
    """The warehouse of the current version; None before the first run."""
    path = versions.current(spark, root)
    if path is None:
        return None
    return Warehouse(
        _before(spark, path, "fact_subscribers", FACT_SUBSCRIBERS),
        seed_dimensions(spark, industries=industries),
        _before(spark, path, "fact_model_predictions", FACT_PREDICTIONS),
    )
