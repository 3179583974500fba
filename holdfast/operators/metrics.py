"""Classifier metrics by model, from counts per distinct score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from holdfast.config import DEFAULT, Rules
from holdfast.functions.exact import ratio
from holdfast.operators.joins import join_own_aggregate


def _score_bucket(score: Column) -> Column:
    """Order-keeping bucket; 4096 per halving of the score, down to a millionth.

    Scores that crowd near zero, as those of a rare class do, still spread.
    """
    return F.floor(F.log2(1.0 + F.greatest(score, F.lit(0.0)) * 1_048_576) * 4096).cast("int")


def _score_counts(scored: DataFrame) -> DataFrame:
    """(model_name, score, pos, neg), with an ordered coarse bucket of the score.

    Rows without a score are left out.
    """
    actual = F.col("churned_actual")
    return (
        scored.filter("churn_probability IS NOT NULL")
        .groupBy("model_name", F.col("churn_probability").alias("score"))
        .agg(F.count_if(actual == 1).alias("pos"), F.count_if(actual == 0).alias("neg"))
        .withColumn("bucket", _score_bucket(F.col("score")))
    )


def _positioned(scored: DataFrame) -> DataFrame:
    """Adds pos_above, neg_above (rows with a higher score) and the class totals.

    Scores are summed per bucket first; only the bucket totals form one window per
    model. Within a bucket the window runs over its distinct scores.
    """
    counts = _score_counts(scored)
    by_model = Window.partitionBy("model_name")
    higher = by_model.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        counts.groupBy("model_name", "bucket")
        .agg(F.sum("pos").alias("b_pos"), F.sum("neg").alias("b_neg"))
        .select(
            "model_name",
            "bucket",
            F.coalesce(F.sum("b_pos").over(higher), F.lit(0)).alias("b_pos_above"),
            F.coalesce(F.sum("b_neg").over(higher), F.lit(0)).alias("b_neg_above"),
            F.sum("b_pos").over(by_model).alias("all_pos"),
            F.sum("b_neg").over(by_model).alias("all_neg"),
        )
    )
    inside = (
        Window.partitionBy("model_name", "bucket")
        .orderBy(F.desc("score"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        join_own_aggregate(counts, totals, ["model_name", "bucket"])
        .withColumn("pos_above", F.col("b_pos_above") + F.sum("pos").over(inside) - F.col("pos"))
        .withColumn("neg_above", F.col("b_neg_above") + F.sum("neg").over(inside) - F.col("neg"))
    )


def _big(c: Column) -> Column:
    return c.cast("decimal(18,0)")


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """roc_auc (ties count half) and pr_auc (step sum) per model.

    Null where a class is missing.
    """
    pos, neg = F.col("pos"), F.col("neg")
    pos_above, neg_above = F.col("pos_above"), F.col("neg_above")
    seen_pos = (pos_above + pos).cast("double")
    seen = seen_pos + (neg_above + neg).cast("double")
    # Twice the number of correctly ordered pairs: each negative against the positives above.
    pairs = F.sum(_big(neg) * _big(pos_above * 2 + pos))
    return (
        _positioned(scored)
        .groupBy("model_name")
        .agg(
            pairs.alias("pairs"),
            F.sum(pos.cast("double") * seen_pos / seen).alias("steps"),
            F.max("all_pos").alias("all_pos"),
            F.max("all_neg").alias("all_neg"),
        )
        .select(
            "model_name",
            F.round(
                F.try_divide(
                    F.col("pairs").cast("double"),
                    2.0 * F.col("all_pos").cast("double") * F.col("all_neg").cast("double"),
                ),
                4,
            ).alias("roc_auc"),
            F.round(F.try_divide("steps", F.col("all_pos").cast("double")), 4).alias("pr_auc"),
        )
    )


def threshold_metrics(scored: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Confusion counts, f1, precision and recall at the decision threshold; 0 if undefined."""
    hit = F.col("score") >= rules.threshold

    def total(n: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(n)).otherwise(0))

    counts = (
        _score_counts(scored)
        .groupBy("model_name")
        .agg(
            total("pos", hit).alias("tp"),
            total("neg", hit).alias("fp"),
            total("pos", ~hit).alias("fn"),
            total("neg", ~hit).alias("tn"),
        )
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def score(num: Column, den: Column) -> Column:
        return F.coalesce(ratio(num, den, 4).cast("double"), F.lit(0.0))

    return counts.select(
        "model_name", "tp", "fp", "fn", "tn",
        score(2 * tp, 2 * tp + fp + fn).alias("f1"),
        score(tp, tp + fp).alias("precision"),
        score(tp, tp + fn).alias("recall"),
    )


def compare_models(scored: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """One row per model with all metrics.

    ``scored`` has model_name, churn_probability and churned_actual.
    """
    # Both halves start from the same counts per score, so the scored rows are read once.
    return (
        join_own_aggregate(
            ranking_metrics(scored), threshold_metrics(scored, rules), ["model_name"]
        )
        .select(
            F.col("model_name").alias("model"),
            "roc_auc", "pr_auc", "f1", "precision", "recall",
            F.lit(rules.threshold).alias("threshold"),
        )
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class: n, balanced weight n_all / (2 n_class), and majority/minority weight."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    everyone = Window.partitionBy()
    n_all = F.sum("n").over(everyone)
    n_neg = F.sum(F.when(F.col("label") == 0, F.col("n"))).over(everyone)
    return counts.select(
        "label",
        "n",
        ratio(n_all, 2 * F.col("n"), 6).cast("double").alias("balanced_weight"),
        F.when(F.col("label") == 1, ratio(n_neg, F.col("n"), 6))
        .otherwise(F.lit(1))
        .cast("double")
        .alias("imbalance_weight"),
    )
