"""Table constraints as violation counts, orphan checks and cross-layer reconciliation."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import BILLING_CYCLES, PLAN_TIERS, REGION_CODES, RISK_TIERS
from holdfast.functions.exact import rate_pct

# Columns of the fact table that may not be null.
FACT_REQUIRED = (
    "subscriber_id", "plan_id", "region_id", "channel_id", "industry_id",
    "subscription_start_date", "billing_cycle", "contract_months", "tenure_months",
    "monthly_fee_per_seat", "seat_count", "total_contract_value", "monthly_arr_usd",
    "support_tickets_90d", "payment_failures_12m", "n_integrations", "churned",
)
PREDICTION_REQUIRED = (
    "subscriber_id", "model_name", "run_id", "churn_probability", "predicted_churned",
    "risk_tier", "predicted_at",
)
RUN_REQUIRED = ("run_id", "model_name", "trained_at", "data_hash", "n_train", "n_test")
CHANNEL_TYPES = ("inbound", "outbound", "partnership", "viral")


def _fact_checks() -> dict[str, Column]:
    c = F.col
    return {
        "billing_cycle": c("billing_cycle").isin(*BILLING_CYCLES),
        "contract_months": c("contract_months").isin(1, 12),
        "tenure_months": c("tenure_months") >= 0,
        "monthly_fee_per_seat": c("monthly_fee_per_seat") > 0,
        "seat_count": c("seat_count") > 0,
        "engagement_score": c("engagement_score").between(0, 100),
        "payment_failures_12m": c("payment_failures_12m") >= 0,
        "feature_adoption_rate": c("feature_adoption_rate").between(0, 1),
        "churned": c("churned").isin(0, 1),
    }


def _prediction_checks() -> dict[str, Column]:
    c = F.col
    return {
        "churn_probability": c("churn_probability").between(0, 1),
        "predicted_churned": c("predicted_churned").isin(0, 1),
        "risk_tier": c("risk_tier").isin(*RISK_TIERS),
    }


def _count_violations(df: DataFrame, table: str, required, checks: dict[str, Column]) -> DataFrame:
    # One scan per table; a check that evaluates to null passes, as in SQL.
    tests = {f"not_null:{c}": F.col(c).isNull() for c in required}
    tests |= {f"check:{name}": ~ok for name, ok in checks.items()}
    counted = df.agg(*[F.count_if(bad).alias(name) for name, bad in tests.items()])
    rows = F.array(
        *[
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(name).alias("constraint_name"),
                F.col(f"`{name}`").cast("bigint").alias("n_violations"),
            )
            for name in tests
        ]
    )
    return counted.select(F.inline(rows))


def constraint_violations(fact: DataFrame, predictions: DataFrame) -> DataFrame:
    return _count_violations(
        fact, "fact_subscribers", FACT_REQUIRED, _fact_checks()
    ).unionByName(
        _count_violations(
            predictions, "fact_model_predictions", PREDICTION_REQUIRED, _prediction_checks()
        )
    )


@dataclass(frozen=True)
class TableRules:
    """Columns that may not be null, conditions by name, and keys by name."""

    required: tuple[str, ...] = ()
    checks: dict[str, Column] = field(default_factory=dict)
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)


def table_rules() -> dict[str, TableRules]:
    """Declared rules of every table of the warehouse."""
    c = F.col
    return {
        "dim_plan": TableRules(
            ("plan_id", "plan_tier", "tier_rank", "base_price_floor", "base_price_ceil"),
            {"plan_tier": c("plan_tier").isin(*PLAN_TIERS), "tier_rank": c("tier_rank").between(1, 4)},
            {"primary_key:plan_id": ("plan_id",), "unique:plan_tier": ("plan_tier",)},
        ),
        "dim_region": TableRules(
            ("region_id", "region_code", "region_name"),
            {"region_code": c("region_code").isin(*REGION_CODES)},
            {"primary_key:region_id": ("region_id",), "unique:region_code": ("region_code",)},
        ),
        "dim_channel": TableRules(
            ("channel_id", "channel_code", "channel_type"),
            {"channel_type": c("channel_type").isin(*CHANNEL_TYPES)},
            {"primary_key:channel_id": ("channel_id",), "unique:channel_code": ("channel_code",)},
        ),
        "dim_industry": TableRules(
            ("industry_id", "industry_name"), {},
            {"primary_key:industry_id": ("industry_id",), "unique:industry_name": ("industry_name",)},
        ),
        "fact_subscribers": TableRules(
            FACT_REQUIRED, _fact_checks(), {"primary_key:subscriber_id": ("subscriber_id",)}
        ),
        "fact_model_predictions": TableRules(
            PREDICTION_REQUIRED, _prediction_checks(),
            {"primary_key:subscriber_id,model_name": ("subscriber_id", "model_name")},
        ),
        "fact_model_runs": TableRules(
            RUN_REQUIRED, {}, {"primary_key:run_id": ("run_id",)}
        ),
    }


def _key_text(columns: tuple[str, ...]) -> Column:
    """One text per key, null where a part is null; lengths keep parts apart."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[x for t in texts for x in (F.length(t).cast("string"), F.lit(":"), t)])


def rule_violations(df: DataFrame, table: str, rules: TableRules) -> DataFrame:
    """table_name, constraint_name, n_violations of every rule, from one pass over the rows.

    Each row gives an entry per key and per rule that it breaks; entries are counted per rule and key,
    combined before the shuffle, so repeats of a hot key do not meet in one task. A key is broken
    by every row beyond its first; a null in a key is left to the rule that forbids it. A check that
    evaluates to null passes, as in SQL.
    """
    broken = {f"not_null:{c}": F.col(c).isNull() for c in rules.required}
    broken |= {f"check:{name}": ~ok for name, ok in rules.checks.items()}
    entries = [
        F.when(bad, F.struct(F.lit(name).alias("constraint_name"), F.lit(None).cast("string").alias("key")))
        for name, bad in broken.items()
    ]
    for name, columns in rules.keys.items():
        key = _key_text(columns)
        entries.append(F.when(key.isNotNull(), F.struct(F.lit(name).alias("constraint_name"), key.alias("key"))))
    counted = (
        df.select(F.inline(F.array_compact(F.array(*entries))))
        .groupBy("constraint_name", "key")
        .agg(F.count("*").alias("n"))
    )
    wrong = F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(F.col("n") - 1))
    found = counted.groupBy("constraint_name").agg(wrong.alias("n_violations"))
    names = [*broken, *rules.keys]
    declared = df.sparkSession.sql("VALUES " + ", ".join(f"('{n}')" for n in names)).toDF("constraint_name")
    return declared.join(found, "constraint_name", "left").select(
        F.lit(table).alias("table_name"), "constraint_name",
        F.coalesce("n_violations", F.lit(0)).cast("bigint").alias("n_violations"),
    )


def all_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations of the declared rules of the given tables."""
    declared = table_rules()
    return reduce(DataFrame.unionByName, [rule_violations(df, name, declared[name]) for name, df in tables.items()])


def orphans(child: DataFrame, parent: DataFrame, key: str, reference: str) -> DataFrame:
    """One row: reference name and number of child rows without a parent."""
    lost = child.select(key).join(parent.select(key), key, "left_anti")
    return lost.agg(F.count("*").alias("n_orphans")).select(
        F.lit(reference).alias("reference"), "n_orphans"
    )


def all_orphans(fact, predictions, dims: dict[str, DataFrame]) -> DataFrame:
    parts = [orphans(fact, dim, key, f"fact_subscribers.{key}") for key, dim in dims.items()]
    parts.append(
        orphans(predictions, fact, "subscriber_id", "fact_model_predictions.subscriber_id")
    )
    return reduce(DataFrame.unionByName, parts)


def lookup_misses(cleaned: DataFrame, dims) -> DataFrame:
    """Codes that match no dimension row and so fall to the default id, per dimension."""
    sides = {
        "plan": (F.lower("plan_tier"), dims.plans, "plan_tier"),
        "region": (F.upper("region"), dims.regions, "region_code"),
        "channel": (F.lower("acquisition_channel"), dims.channels, "channel_code"),
        "industry": (F.col("industry_vertical"), dims.industries, "industry_name"),
    }
    parts = []
    for name, (code, dim, key) in sides.items():
        unmatched = cleaned.select(code.alias(key)).join(dim.select(key), key, "left_anti")
        parts.append(
            unmatched.agg(F.count("*").alias("n_defaulted")).select(
                F.lit(name).alias("dimension"), "n_defaulted"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def reconcile(fact: DataFrame, cleaned: DataFrame, fact_by_plan: DataFrame) -> DataFrame:
    """Count and churn rate from the fact, the cleaned rows and the per-plan sums."""

    def measures(df: DataFrame, layer: str, n: Column, churned: Column) -> DataFrame:
        return df.agg(n.alias("n"), churned.alias("n_churned")).select(
            F.lit(layer).alias("layer"),
            "n",
            "n_churned",
            rate_pct(F.col("n_churned"), F.col("n")).cast("double").alias("churn_rate_pct"),
        )

    return (
        measures(fact, "fact", F.count("*"), F.sum("churned"))
        .unionByName(measures(cleaned, "cleaned", F.count("*"), F.sum("churned")))
        .unionByName(
            measures(fact_by_plan, "plan_totals", F.sum("n_subscribers"), F.sum("n_churned"))
        )
    )
