"""Star schema: dimension seeds, key lookup, loading of accounts and predictions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.config import DEFAULT, Rules
from holdfast.functions.business import annual_revenue, risk_tier
from holdfast.functions.exact import not_nan
from holdfast.operators.keyed import insert_absent, last_per_key, upsert
from holdfast.schemas import (
    DIM_CHANNEL,
    DIM_INDUSTRY,
    DIM_PLAN,
    DIM_REGION,
    FACT_MODEL_RUNS,
    FACT_PREDICTIONS,
    FACT_SUBSCRIBERS,
    column_names,
)

# Seed rows of the dimensions. Ids follow the order of the rows.
PLAN_ROWS = (
    ("starter", 1, "9.99", "29.99", "Entry-level plan for small teams"),
    ("growth", 2, "29.99", "79.99", "Mid-market plan for growing teams"),
    ("professional", 3, "79.99", "199.99", "Full-featured plan for established businesses"),
    ("enterprise", 4, "199.99", "499.99", "Custom plan for large organisations"),
)
REGION_ROWS = (
    ("NAM", "North America"),
    ("EMEA", "Europe, Middle East & Africa"),
    ("APAC", "Asia-Pacific"),
    ("LATAM", "Latin America"),
)
CHANNEL_ROWS = (
    ("organic", "inbound"),
    ("paid_search", "outbound"),
    ("referral", "viral"),
    ("partner", "partnership"),
    ("direct_sales", "outbound"),
    ("trial_convert", "inbound"),
)
INDUSTRY_NAMES = (
    "Software & SaaS", "E-commerce", "Financial Services", "Healthcare IT",
    "Professional Services", "Manufacturing", "Media & Entertainment", "Education",
)


def _seed(spark: SparkSession, rows, ddl: str) -> DataFrame:
    # An inline table is a local relation, so Catalyst knows that it is small.
    def sql_text(value) -> str:
        return "'" + str(value).replace("'", "''") + "'"

    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(ddl)
    values = ", ".join(
        "(" + ", ".join([str(i), *map(sql_text, row)]) + ")" for i, row in enumerate(rows, 1)
    )
    names = ", ".join(fields.names)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    return table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


@dataclass(frozen=True)
class Dimensions:
    plans: DataFrame
    regions: DataFrame
    channels: DataFrame
    industries: DataFrame

    def by_key(self) -> dict[str, DataFrame]:
        return {
            "plan_id": self.plans,
            "region_id": self.regions,
            "channel_id": self.channels,
            "industry_id": self.industries,
        }


def seed_dimensions(
    spark: SparkSession,
    existing: Dimensions | None = None,
    industries: tuple[str, ...] = INDUSTRY_NAMES,
) -> Dimensions:
    """Seed rows added where their code is absent, with new ids; present rows stay as they are."""
    seeds = Dimensions(
        _seed(spark, PLAN_ROWS, DIM_PLAN),
        _seed(spark, REGION_ROWS, DIM_REGION),
        _seed(spark, CHANNEL_ROWS, DIM_CHANNEL),
        _seed(spark, [(n,) for n in industries], DIM_INDUSTRY),
    )
    if existing is None:
        return seeds
    return Dimensions(
        insert_absent(existing.plans, seeds.plans, "plan_tier", "plan_id"),
        insert_absent(existing.regions, seeds.regions, "region_code", "region_id"),
        insert_absent(existing.channels, seeds.channels, "channel_code", "channel_id"),
        insert_absent(existing.industries, seeds.industries, "industry_name", "industry_id"),
    )


def lookup_keys(accounts: DataFrame, dims: Dimensions) -> DataFrame:
    """Adds the four surrogate keys; a code without a match gets id 1."""

    def attach(df: DataFrame, code: Column, dim: DataFrame, key: str, id_col: str) -> DataFrame:
        lookup = dim.select(F.col(key).alias("code"), F.col(id_col).alias("found"))
        return (
            df.withColumn("code", code)
            .join(lookup, "code", "left")
            .withColumn(id_col, F.coalesce("found", F.lit(1)))
            .drop("code", "found")
        )

    out = attach(accounts, F.lower("plan_tier"), dims.plans, "plan_tier", "plan_id")
    out = attach(out, F.upper("region"), dims.regions, "region_code", "region_id")
    out = attach(out, F.lower("acquisition_channel"), dims.channels, "channel_code", "channel_id")
    return attach(
        out, F.col("industry_vertical"), dims.industries, "industry_name", "industry_id"
    )


def fact_rows(accounts: DataFrame, dims: Dimensions) -> DataFrame:
    rows = lookup_keys(accounts, dims).withColumns(
        {
            "billing_cycle": F.lower("billing_cycle"),
            "monthly_arr_usd": annual_revenue(
                F.col("monthly_fee_per_seat"), F.col("seat_count")
            ),
        }
    )
    return rows.select(*column_names(FACT_SUBSCRIBERS))


def load_subscribers(
    accounts: DataFrame, dims: Dimensions, existing: DataFrame | None = None, order: str | None = None
) -> DataFrame:
    """Fact table after the load: one row per account, the loaded row wins.

    ``accounts`` holds one row per account, as cleaning leaves it, unless ``order`` names the
    column whose highest value wins among repeats.
    """
    if order is None:
        rows = fact_rows(accounts, dims)
        if existing is None:
            return rows
        return upsert(existing, rows.withColumn("seq", F.lit(1)), ["subscriber_id"], "seq")
    last = last_per_key(accounts, ["subscriber_id"], F.col(order))
    return load_subscribers(last, dims, existing)


def prediction_rows(
    scored: DataFrame,
    model_name: str,
    run_id: str,
    predicted_at: Column,
    rules: Rules = DEFAULT,
    threshold: float | None = None,
) -> DataFrame:
    """Prediction records of (subscriber_id, churn_probability) rows."""
    limit = rules.threshold if threshold is None else threshold
    p = not_nan(F.col("churn_probability").cast("double"))
    return (
        scored.withColumns(
            {
                "model_name": F.lit(model_name),
                "run_id": F.lit(run_id),
                "churn_probability": p,
                "predicted_at": predicted_at.cast("timestamp"),
            }
        )
        .withColumns(
            {
                "predicted_churned": (F.col("churn_probability") >= limit).cast("int"),
                "risk_tier": risk_tier(F.col("churn_probability"), rules),
            }
        )
        .select(*column_names(FACT_PREDICTIONS))
    )


def load_predictions(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Prediction table after the load, unique by account and model."""
    keys = ["subscriber_id", "model_name"]
    if existing is None:
        return last_per_key(rows, keys, F.col("predicted_at"))
    return upsert(existing, rows.withColumn("seq", F.col("predicted_at")), keys, "seq")


def append_predictions(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Plain append, as a table without a unique key would take it."""
    return existing.unionByName(rows)


def denormalise(fact: DataFrame, dims: Dimensions) -> DataFrame:
    """Flat documents: codes in place of surrogate keys, NaN as null."""
    flat = (
        fact.join(dims.plans.select("plan_id", "plan_tier"), "plan_id")
        .join(dims.regions.select("region_id", "region_code"), "region_id")
        .join(dims.channels.select("channel_id", "channel_code", "channel_type"), "channel_id")
        .join(
            dims.industries.select(
                "industry_id", F.col("industry_name").alias("industry_vertical")
            ),
            "industry_id",
        )
    )
    codes = ["plan_tier", "region_code", "channel_code", "channel_type", "industry_vertical"]
    rest = [c for c in fact.columns if c != "subscriber_id" and not c.endswith("_id")]
    floating = {n for n, t in flat.dtypes if t in ("double", "float")}
    return flat.select(
        "subscriber_id",
        *codes,
        *[not_nan(F.col(c)).alias(c) if c in floating else F.col(c) for c in rest],
    )


@dataclass(frozen=True)
class Warehouse:
    fact: DataFrame
    dims: Dimensions
    predictions: DataFrame

    def register_views(self) -> None:
        """Tables as temporary views, for SQL text."""
        tables = {
            "fact_subscribers": self.fact,
            "fact_model_predictions": self.predictions,
            "dim_plan": self.dims.plans,
            "dim_region": self.dims.regions,
            "dim_channel": self.dims.channels,
            "dim_industry": self.dims.industries,
        }
        for name, df in tables.items():
            df.createOrReplaceTempView(name)

    def with_predictions(self, predictions: DataFrame) -> Warehouse:
        return replace(self, predictions=predictions)


def empty_table(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def create_schema(spark: SparkSession) -> dict[str, DataFrame]:
    """Empty fact tables and seeded dimensions; calling it again gives the same."""
    dims = seed_dimensions(spark)
    return {
        "fact_subscribers": empty_table(spark, FACT_SUBSCRIBERS),
        "fact_model_predictions": empty_table(spark, FACT_PREDICTIONS),
        "fact_model_runs": empty_table(spark, FACT_MODEL_RUNS),
        "dim_plan": dims.plans,
        "dim_region": dims.regions,
        "dim_channel": dims.channels,
        "dim_industry": dims.industries,
    }
