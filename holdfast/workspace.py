"""Tables of one input folder, derived and staged once per session.

The registered queries ask questions of a loaded warehouse. Loading it - deriving the
accounts, cleaning, keying, scoring - happens on first use and is written to the shared
scratch folder; every later query scans the written tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.business import heuristic_churn_score
from holdfast.operators import cleaning
from holdfast.operators.features import build_features, fit_decile_edges, fit_preparation
from holdfast.operators.warehouse import (
    Dimensions,
    Warehouse,
    denormalise,
    load_subscribers,
    prediction_rows,
    seed_dimensions,
)
from holdfast.session import deal_by_size, stage
from holdfast.sources.accounts import MARKET_SEGMENTS, derive_accounts

PREDICTED_AT = "2024-12-31 00:00:00"
HEURISTIC, SIMPLE = "heuristic", "simple_risk"
SOURCES = ("customer", "orders", "lineitem")


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def raw(self) -> DataFrame:
        return stage(derive_accounts(self.spark, self.sf_dir), "subscribers_raw")

    @cached_property
    def deduped(self) -> DataFrame:
        return stage(cleaning.remove_duplicates(self.raw), "deduped")

    @cached_property
    def fit(self) -> cleaning.CleaningFit:
        return cleaning.fit(self.deduped)

    @cached_property
    def clean(self) -> DataFrame:
        return stage(cleaning.apply(self.deduped, self.fit), "subscribers_clean")

    @cached_property
    def dims(self) -> Dimensions:
        return seed_dimensions(self.spark, industries=MARKET_SEGMENTS)

    @cached_property
    def fact(self) -> DataFrame:
        return stage(load_subscribers(self.clean, self.dims), "fact_subscribers")

    @cached_property
    def features(self) -> DataFrame:
        return stage(build_features(self.clean, self.edges), "features")

    @cached_property
    def edges(self) -> list:
        return fit_decile_edges(self.clean)

    @cached_property
    def preparation(self):
        return fit_preparation(self.features)

    @cached_property
    def predictions(self) -> DataFrame:
        """Two deterministic scores of every account."""
        at = F.lit(PREDICTED_AT)
        by_logit = self.clean.select(
            "subscriber_id", heuristic_churn_score().alias("churn_probability")
        )
        by_rule = self.features.select(
            "subscriber_id", F.col("risk_score_simple").alias("churn_probability")
        )
        rows = prediction_rows(by_logit, HEURISTIC, "fixture", at).unionByName(
            prediction_rows(by_rule, SIMPLE, "fixture", at)
        )
        return stage(rows, "fact_model_predictions")

    @property
    def warehouse(self) -> Warehouse:
        return Warehouse(self.fact, self.dims, self.predictions)

    @cached_property
    def documents(self) -> DataFrame:
        return stage(denormalise(self.fact, self.dims), "documents")

    @property
    def scored(self) -> DataFrame:
        """Predictions next to what happened."""
        actual = self.fact.select("subscriber_id", F.col("churned").alias("churned_actual"))
        return self.predictions.join(actual, "subscriber_id")


_open: dict[tuple, Workspace] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, size and time of the input files, so that changed input is loaded anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(
        sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in listed)
    )


def open_workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir))
    if key not in _open:
        _open[key] = Workspace(spark, sf_dir)
    # What the accounts are derived from; every table of the warehouse grows with it.
    deal_by_size(spark, sum(size for name, size, _ in key[2] if name.split(".")[0] in SOURCES))
    return _open[key]
