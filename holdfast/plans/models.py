"""Training, scoring and evaluation of churn classifiers with MLlib."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import DEFAULT, Rules
from holdfast.functions.exact import hash_bucket
from holdfast.operators.categories import CategoryEncoder
from holdfast.operators.features import LABEL, Preparation, fit_preparation
from holdfast.operators.metrics import compare_models, ranking_metrics
from holdfast.operators.splits import BUCKETS, salted, stratified_folds
from holdfast.plans import boosting, neural
from holdfast.session import stage, stage_evenly

KEY = "subscriber_id"


def scaling_stage(prep: Preparation) -> SQLTransformer:
    """Numbers less their mean over their deviation, missing ones as 0; flags as numbers."""
    scaled = [
        f"(coalesce(CAST({c} AS DOUBLE), 0D) - {mean!r}D) / {std!r}D AS {c}_scaled"
        for c, (mean, std) in prep.scales.items()
    ]
    flags = [f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}_flag" for c in prep.binary]
    return SQLTransformer(statement="SELECT *, " + ", ".join([*scaled, *flags]) + " FROM __THIS__")


def code_stage(prep: Preparation) -> CategoryEncoder | None:
    """Codes of the text columns that have more than one value, from the index table."""
    sizes = {c: n for c, n in prep.sizes.items() if n > 1}
    return CategoryEncoder(prep.index, sizes) if sizes else None


def preparation_stages(prep: Preparation) -> list:
    """Scaling, one-hot encoding and assembly as stages that can be saved with a model.

    Each text column becomes a sparse vector with a place per value but the first; the first, null and
    unseen values are 0 everywhere.
    """
    flags = [f"{c}_flag" for c in prep.binary]
    stages, hot, codes = [scaling_stage(prep)], [], []
    encoder = code_stage(prep)
    if encoder is not None:
        codes = encoder.code_names()
        hot = [f"{c}_hot" for c in encoder.sizes]
        one_hot = OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=True).fit(encoder.empty())
        stages += [encoder, one_hot]
    inputs = [*prep.scaled_names(), *hot, *flags]
    narrow = "SELECT * EXCEPT (" + ", ".join([*inputs, *codes]) + ") FROM __THIS__"
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features"), SQLTransformer(statement=narrow)]


def n_inputs(prep: Preparation) -> int:
    return len(prep.scales) + sum(max(n - 1, 0) for n in prep.sizes.values()) + len(prep.binary)


def with_class_weight(train: DataFrame, prep: Preparation) -> DataFrame:
    """Balanced weights: all rows / (2 x rows of the class)."""
    negatives = prep.n_rows - prep.n_positive

    def weight(n: int) -> Column:
        return F.lit(prep.n_rows / (2 * n) if n else 0.0)

    return train.withColumn(
        "weight", F.when(F.col(LABEL) == 1, weight(prep.n_positive)).otherwise(weight(negatives))
    )


def _fit(prep: Preparation, estimator, train: DataFrame) -> PipelineModel:
    prepared = PipelineModel(preparation_stages(prep))
    columns = ["features", estimator.getLabelCol(), estimator.getWeightCol()]
    # Written once: a learner that passes over the rows does not join the category index every time.
    fitted = estimator.fit(stage_evenly(prepared.transform(train).select(*columns), "prepared"))
    return PipelineModel([*prepared.stages, fitted])


def train_logistic(train: DataFrame, rules: Rules = DEFAULT) -> PipelineModel:
    """L2 penalty of strength 1 on the summed loss, balanced classes."""
    prep = fit_preparation(train)
    estimator = LogisticRegression(
        labelCol=LABEL, weightCol="weight", regParam=1.0 / prep.n_rows, elasticNetParam=0.0,
        standardization=False, maxIter=1000, tol=1e-4,
    )
    return _fit(prep, estimator, with_class_weight(train, prep))


def train_forest(train: DataFrame, rules: Rules = DEFAULT, trees: int = 300) -> PipelineModel:
    # Rows keep their node of every tree, instead of walking all trees from the root on every level.
    estimator = RandomForestClassifier(
        labelCol=LABEL, weightCol="weight", numTrees=trees, maxDepth=10,
        minInstancesPerNode=4, seed=rules.seed, cacheNodeIds=True,
    )
    prep = fit_preparation(train)
    return _fit(prep, estimator, with_class_weight(train, prep))


def stopping_round(losses: list[float], patience: int) -> int | None:
    """Round after ``patience`` rounds without a new lowest loss; None if it never comes."""
    best, best_round = float("inf"), 0
    for i, loss in enumerate(losses, 1):
        if loss < best:
            best, best_round = loss, i
        elif i - best_round >= patience:
            return i
    return None


def train_boosting(
    train: DataFrame, rules: Rules = DEFAULT, rounds: int = 400, patience: int = 20
) -> PipelineModel:
    """Histogram boosting with an L2 penalty on the leaves; a tenth of the rows decides when to stop."""
    prep = fit_preparation(train)
    encoder = code_stage(prep)
    rows = with_class_weight(train, prep)
    rows = encoder.transform(rows) if encoder else rows
    bins = boosting.fit_bins(rows, [*prep.scales, *prep.binary], encoder.code_names() if encoder else [])
    is_held_out = hash_bucket(salted(F.col(KEY), rules.seed, "early_stop"), 10) == 0
    rows = rows.select(
        bins.column().alias("bins"), F.col(LABEL).cast("double").alias("label"), "weight", is_held_out.alias("held_out")
    )
    # Balanced classes weigh the same, so the margin starts at even odds.
    settings = boosting.Settings(rounds=rounds, patience=patience)
    trees, _ = boosting.grow(rows, bins, 0.0, settings)
    fitted = boosting.BoostedTrees(bins, 0.0, trees)
    return PipelineModel([encoder, fitted] if encoder else [fitted])


def balance_by_copies(
    train: DataFrame, prep: Preparation, rules: Rules = DEFAULT
) -> DataFrame:
    """Positives repeated until both classes weigh the same, for learners without weights; ours have them."""
    negatives = prep.n_rows - prep.n_positive
    wanted = max(1.0, negatives / prep.n_positive) if prep.n_positive else 1.0
    whole = int(wanted)
    draw = hash_bucket(salted(F.col(KEY), rules.seed, "copies"), BUCKETS) / BUCKETS
    copies = F.when(F.col(LABEL) == 1, whole + (draw < wanted - whole).cast("int")).otherwise(1)
    return train.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")


def train_perceptron(train: DataFrame, rules: Rules = DEFAULT, epochs: int = 80) -> PipelineModel:
    """Neural classifier over scaled numbers, flags and embedded text columns; classes weigh the same."""
    prep = fit_preparation(train)
    encoder = code_stage(prep)
    stages = [scaling_stage(prep), *([encoder] if encoder else [])]
    rows = PipelineModel(stages).transform(with_class_weight(train, prep))
    codes = encoder.code_names() if encoder else []
    net = neural.NeuralNet([*prep.scaled_names(), *[f"{c}_flag" for c in prep.binary]], codes, [])
    numbers, at = net.columns()
    is_held_out = hash_bucket(salted(F.col(KEY), rules.seed, "early_stop"), 10) == 0
    rows = rows.select(
        numbers.alias("numbers"), at.alias("codes"), F.col(LABEL).cast("double").alias("label"), "weight",
        is_held_out.alias("held_out"),
    )
    # A code per value but the first, and one for all others.
    sizes = list(encoder.sizes.values()) if encoder else []
    settings = neural.Settings(steps=epochs, seed=rules.seed)
    net.weights = neural.train(rows, len(net.numbers), sizes, settings)
    return PipelineModel([*stages, net])


TRAINERS: dict[str, Callable[..., PipelineModel]] = {
    "logistic_regression": train_logistic,
    "random_forest": train_forest,
    "gradient_boost": train_boosting,
}


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(subscriber_id, churn_probability, churned_actual); the key never leaves the rows."""
    positive = vector_to_array(F.col("probability"))[1]
    return model.transform(df).select(
        KEY, positive.alias("churn_probability"), F.col(LABEL).alias("churned_actual")
    )


def cross_validate(
    train: DataFrame,
    trainer: Callable[..., PipelineModel],
    rules: Rules = DEFAULT,
) -> DataFrame:
    """Mean and population deviation of both ranking metrics over the folds."""
    folds = stage(stratified_folds(train, KEY, LABEL, rules), "folds")
    held_out = {}
    for k in range(rules.folds):
        model = trainer(folds.filter(F.col("fold") != k).drop("fold"), rules)
        held_out[f"fold_{k}"] = score(model, folds.filter(F.col("fold") == k))
    per_fold = ranking_metrics(stack(held_out))
    return per_fold.agg(
        *[
            F.round(f(m), 4).alias(f"cv_{m}_{name}")
            for m in ("roc_auc", "pr_auc")
            for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))
        ]
    )


def stack(scored: dict[str, DataFrame]) -> DataFrame:
    """Scored frames under each other, with their names in model_name."""
    return reduce(
        DataFrame.unionByName,
        [df.withColumn("model_name", F.lit(name)) for name, df in scored.items()],
    )


def evaluate(scored: dict[str, DataFrame], rules: Rules = DEFAULT) -> DataFrame:
    """Comparison table of several scored frames; every model scores its rows once."""
    return compare_models(stage(stack(scored), "scored"), rules)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def run_record(
    comparison: DataFrame,
    trained_at: Column,
    data_hash: str,
    n_train: int,
    n_test: int,
    artifact_root: str,
) -> DataFrame:
    """Provenance rows, one per model of the comparison."""
    name = F.col("model")
    run = F.concat(name, F.lit("_"), F.date_format(trained_at, "yyyyMMdd'T'HHmmss"))
    return comparison.select(
        run.alias("run_id"),
        name.alias("model_name"),
        trained_at.cast("timestamp").alias("trained_at"),
        F.lit(data_hash).alias("data_hash"),
        F.lit(n_train).cast("bigint").alias("n_train"),
        F.lit(n_test).cast("bigint").alias("n_test"),
        "roc_auc",
        "pr_auc",
        F.col("f1").alias("f1_score"),
        F.col("precision").alias("precision_score"),
        F.col("recall").alias("recall_score"),
        F.col("threshold").alias("threshold_used"),
        F.concat(F.lit(artifact_root + "/"), name).alias("artifact_path"),
    )
