"""Read-only diagnosis: profile and rule violations of the raw accounts, constraint checks."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import BILLING_CYCLES, CHANNELS, DEFAULT, PLAN_TIERS, REGION_CODES, Rules
from holdfast.functions.exact import rate_pct
from holdfast.operators.cleaning import bad_date


@dataclass(frozen=True)
class ColumnRule:
    column: str
    not_null: bool = False
    unique: bool = False
    allowed: tuple[str, ...] = ()
    minimum: Decimal | int | None = None
    maximum: Decimal | int | None = None


def column_rules(rules: Rules = DEFAULT) -> list[ColumnRule]:
    # Which column is held to which rule.
    return [
        ColumnRule("subscriber_id", not_null=True, unique=True),
        ColumnRule("plan_tier", not_null=True, allowed=PLAN_TIERS),
        ColumnRule("billing_cycle", not_null=True, allowed=BILLING_CYCLES),
        ColumnRule("region", not_null=True, allowed=REGION_CODES),
        ColumnRule("acquisition_channel", not_null=True, allowed=CHANNELS),
        ColumnRule("monthly_fee_per_seat", True, minimum=rules.fee_min, maximum=rules.fee_max),
        ColumnRule("seat_count", True, minimum=rules.seats_min, maximum=rules.seats_max),
        ColumnRule("contract_months", True, minimum=rules.contract_min, maximum=rules.contract_max),
        ColumnRule("tenure_months", True, minimum=0),
        ColumnRule("engagement_score", minimum=0, maximum=100),
        ColumnRule("support_tickets_90d", True, minimum=0),
        ColumnRule("payment_failures_12m", True, minimum=0, maximum=rules.failures_max),
        ColumnRule("n_integrations", True, minimum=0),
        ColumnRule("feature_adoption_rate", minimum=0, maximum=1),
        ColumnRule("churned", True, allowed=("0", "1")),
    ]


def missing_columns(df: DataFrame, rules: Rules = DEFAULT) -> list[str]:
    return [r.column for r in column_rules(rules) if r.column not in df.columns]


def _value_counts(df: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    """(column_name, value, n) over all checked columns in one pass.

    Every measure below is a function of this table, so the accounts are read and
    shuffled once however many columns and rules there are.
    """
    cells = [
        F.struct(F.lit(r.column).alias("column_name"), F.col(r.column).cast("string").alias("value"))
        for r in rules
    ]
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("n"))
    )


def _per_rule(rules: list[ColumnRule], condition) -> Column:
    """Rows that violate the condition of the column they belong to."""
    expr = F.lit(False)
    for r in rules:
        c = condition(r)
        if c is not None:
            expr = F.when(F.col("column_name") == r.column, c).otherwise(expr)
    return F.sum(F.when(F.col("value").isNotNull() & expr, F.col("n")).otherwise(0))


def profile(df: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """One row per checked column that exists, with its counts and violations."""
    present = [r for r in column_rules(rules) if r.column in df.columns]
    types = dict(df.dtypes)
    number = F.col("value").try_cast("double")

    def outside_set(r: ColumnRule):
        return ~F.lower("value").isin(*[a.lower() for a in r.allowed]) if r.allowed else None

    def below(r: ColumnRule):
        return number < float(r.minimum) if r.minimum is not None else None

    def above(r: ColumnRule):
        return number > float(r.maximum) if r.maximum is not None else None

    def flag(names: list[str]) -> Column:
        return F.col("column_name").isin(*names) if names else F.lit(False)

    dtype = F.create_map(*[x for r in present for x in (F.lit(r.column), F.lit(types[r.column]))])
    nulls = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0))
    return (
        _value_counts(df, present)
        .groupBy("column_name")
        .agg(
            F.sum("n").alias("n_total"),
            nulls.alias("n_null"),
            F.count("value").alias("n_unique"),
            _per_rule(present, outside_set).alias("not_allowed"),
            _per_rule(present, below).alias("below_minimum"),
            _per_rule(present, above).alias("above_maximum"),
        )
        .withColumn("dtype", dtype[F.col("column_name")])
        .withColumn("pct_null", rate_pct(F.col("n_null"), F.col("n_total")).cast("double"))
        .withColumn(
            "nulls_found",
            F.when(flag([r.column for r in present if r.not_null]), F.col("n_null")).otherwise(0),
        )
        .withColumn(
            "duplicates",
            F.when(
                flag([r.column for r in present if r.unique]),
                F.col("n_total") - F.col("n_null") - F.col("n_unique"),
            ).otherwise(0),
        )
    )


RULE_NAMES = ("nulls_found", "not_allowed", "below_minimum", "above_maximum", "duplicates")


def violations(df: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Long form: column_name, rule, n_violations, for broken rules only."""
    long = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.col(r).cast("bigint").alias("n_violations"))
            for r in RULE_NAMES
        ]
    )
    return (
        profile(df, rules)
        .select("column_name", F.inline(long))
        .filter("n_violations > 0")
    )


def header(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_cols, n_duplicates, pct_duplicates, n_bad_dates."""
    ids = df.groupBy("subscriber_id").agg(
        F.count("*").alias("n"), F.count_if(bad_date()).alias("bad")
    )
    return (
        ids.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad_dates"),
        )
        .withColumn("n_cols", F.lit(len(df.columns)))
        .withColumn(
            "pct_duplicates", rate_pct(F.col("n_duplicates"), F.col("n_rows")).cast("double")
        )
        .select("n_rows", "n_cols", "n_duplicates", "pct_duplicates", "n_bad_dates")
    )


def _issue_texts() -> Column:
    # Texts of the broken rules of one column, in rule order.
    text = {
        "nulls_found": F.concat(F.col("n_null").cast("string"), F.lit(" nulls")),
        "not_allowed": F.concat(F.col("not_allowed").cast("string"), F.lit(" values not allowed")),
        "below_minimum": F.concat(
            F.col("below_minimum").cast("string"), F.lit(" values below minimum")
        ),
        "above_maximum": F.concat(
            F.col("above_maximum").cast("string"), F.lit(" values above maximum")
        ),
        "duplicates": F.concat(F.col("duplicates").cast("string"), F.lit(" duplicate values")),
    }
    return F.array_compact(F.array(*[F.when(F.col(r) > 0, text[r]) for r in RULE_NAMES]))


def column_reports(df: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    return profile(df, rules).select(
        "column_name", "dtype", "n_total", "n_null", "pct_null", "n_unique",
        _issue_texts().alias("issues"),
    )


def _issue(n: str, text: str) -> Column:
    return F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {text}")))


def report(df: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """One nested row: header, global issues, and a record per checked column.

    The header follows from the profile of the key column, so the keys are counted once.
    """
    is_key = F.col("column_name") == "subscriber_id"
    repeats = F.col("n_total") - F.col("n_unique") - F.least(F.col("n_null"), F.lit(1))
    record = F.struct("column_name", "dtype", "n_total", "n_null", "pct_null", "n_unique", "issues")
    missing = [F.lit(f"Expected column '{c}' is missing") for c in missing_columns(df, rules)]
    issues = [
        _issue("n_duplicates", "duplicate subscriber_id values"),
        _issue("n_bad_dates", "rows where churn_date precedes subscription_start_date"),
        *missing,
    ]
    if {"churn_date", "subscription_start_date"} <= set(df.columns):
        bad_dates = df.agg(F.count_if(bad_date())).scalar()
    else:
        bad_dates = F.lit(0).cast("bigint")
    return (
        column_reports(df, rules)
        .agg(
            F.coalesce(F.max("n_total"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.max(F.when(is_key, repeats)), F.lit(0)).alias("n_duplicates"),
            # Fifteen records at most, one per declared rule.
            F.sort_array(F.collect_list(record)).alias("columns"),
        )
        .withColumn("n_bad_dates", bad_dates)
        .select(
            "n_rows",
            F.lit(len(df.columns)).alias("n_cols"),
            "n_duplicates",
            rate_pct(F.col("n_duplicates"), F.col("n_rows")).cast("double").alias("pct_duplicates"),
            F.array_compact(F.array(*issues)).alias("global_issues"),
            "columns",
        )
    )


def report_lines(nested: DataFrame) -> DataFrame:
    """Readable text of a nested report, one line per row, in order."""
    issue_lines = F.flatten(
        F.transform(
            F.filter("columns", lambda c: F.size(c["issues"]) > 0),
            lambda c: F.concat(
                F.array(F.concat(F.lit("  "), c["column_name"], F.lit(" (null: "),
                                 c["pct_null"].cast("string"), F.lit("%):"))),
                F.transform(c["issues"], lambda i: F.concat(F.lit("      - "), i)),
            ),
        )
    )
    total = F.size("global_issues") + F.aggregate(
        "columns", F.lit(0), lambda a, c: a + F.size(c["issues"])
    )
    lines = F.concat(
        F.array(
            F.concat(
                F.lit("Rows: "), F.col("n_rows").cast("string"),
                F.lit(" | Duplicates: "), F.col("n_duplicates").cast("string"),
                F.lit(" ("), F.col("pct_duplicates").cast("string"),
                F.lit("%) | Total issues: "), total.cast("string"),
            ),
            F.lit("--- Global issues ---"),
        ),
        F.transform("global_issues", lambda i: F.concat(F.lit("  - "), i)),
        F.array(F.lit("--- Column issues ---")),
        issue_lines,
    )
    return nested.select(F.posexplode(lines).alias("line_no", "value"))
