"""Number of shuffle partitions by the size of the input."""

from pyspark.sql import functions as F

from holdfast import session, workspace
from holdfast.plans import models

NAME = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def test_shuffles_start_with_more_partitions_on_larger_input(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    try:
        workspace.open_workspace(spark, folder)
        assert spark.conf.get(NAME, None) is None  # small input: the session's own number
        monkeypatch.setattr(session, "PARTITION_BYTES", 1000)
        workspace.open_workspace(spark, folder)
        many = int(spark.conf.get(NAME))
        assert many > 8
        # Smaller input again, and a number of the caller.
        monkeypatch.setattr(session, "PARTITION_BYTES", 4 << 20)
        workspace.open_workspace(spark, folder)
        assert spark.conf.get(NAME, None) is None
        spark.conf.set(NAME, "3")
        session.deal_by_size(spark, 1 << 40)
        assert spark.conf.get(NAME) == "3"
    finally:
        spark.conf.unset(NAME)


def test_training_rows_are_staged_in_equal_parts(spark):
    rows = session.stage_evenly(spark.range(800).coalesce(1), "rows")
    sizes = [r["count"] for r in rows.groupBy(F.input_file_name().alias("file")).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) - min(sizes) <= 8
    assert rows.rdd.getNumPartitions() == len(sizes)


def test_a_learner_reads_equal_parts(spark, monkeypatch):
    """Before: as many parts as the features had files."""
    seen = []

    class Learner:
        getLabelCol, getWeightCol = (lambda self: "label"), (lambda self: "weight")

        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return models.scaling_stage(prep)

    prep = models.Preparation({"x": (0.0, 1.0)}, None, {}, (), 100, 50)
    train = spark.range(100).coalesce(1).selectExpr("id * 1D AS x", "id % 2 AS label", "1D AS weight")
    models._fit(prep, Learner(), train)
    assert seen == [spark.sparkContext.defaultParallelism]


def test_forest_rows_keep_their_nodes(monkeypatch):
    monkeypatch.setattr(models, "fit_preparation", lambda train: None)
    monkeypatch.setattr(models, "with_class_weight", lambda train, prep: train)
    monkeypatch.setattr(models, "_fit", lambda prep, estimator, train: estimator)
    assert models.train_forest(None).getCacheNodeIds()
