"""Cleaning of raw subscriber accounts, with an audit trail.

``fit`` learns medians and fences from de-duplicated rows in one selection;
the step functions are row-wise expressions that use them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import DEFAULT, Rules
from holdfast.operators.keyed import first_per_key
from holdfast.operators.selection import around, interpolated, values_at_ranks
from holdfast.schemas import CLEAN, column_names
from holdfast.session import stage

LOGINS = "monthly_logins_per_user"
CAPPED = ("support_tickets_90d", LOGINS, "total_contract_value")
QUARTILES = ("0.25", "0.5", "0.75")
_EXACT = "decimal(20,4)"


@dataclass(frozen=True)
class Fences:
    low: Decimal
    high: Decimal


@dataclass(frozen=True)
class CleaningFit:
    """``tier_medians`` has one row per plan tier; the rest is a handful of numbers."""

    tier_medians: DataFrame
    login_median: Decimal | None
    fences: dict[str, Fences]


def remove_duplicates(df: DataFrame) -> DataFrame:
    """First arrived row per subscriber."""
    return first_per_key(df, ["subscriber_id"], F.col("ingest_seq"))


def bad_date(churn: str = "churn_date", start: str = "subscription_start_date") -> Column:
    return F.coalesce(F.col(churn) < F.col(start), F.lit(False))


def bad_fee(rules: Rules = DEFAULT) -> Column:
    return F.coalesce(F.col("monthly_fee_per_seat") < F.lit(rules.fee_min), F.lit(False))


def _quartiles_with_missing(at: dict, missing: int, filler: Decimal) -> dict[str, Decimal]:
    """Quartiles of a column after its missing values became ``filler``.

    With m fillers, the value at rank r is the filler, held between the present values at
    ranks r - m and r.
    """
    present = next(iter(at.values()))["total"]

    def value(rank: int) -> Decimal:
        out = filler
        if rank - missing >= 0:
            out = max(out, at[rank - missing]["at_rank"])
        return min(out, at[rank]["at_rank"]) if rank < present else out

    out = {}
    for p in QUARTILES:
        place = Decimal(p) * (present + missing - 1)
        low, high = value(math.floor(place)), value(math.ceil(place))
        out[p] = low + (high - low) * (place - math.floor(place))
    return out


def fit(deduped: DataFrame, rules: Rules = DEFAULT) -> CleaningFit:
    """Medians per plan tier, the login median, and the outlier fences.

    Every measure becomes (measure, tier, value) rows, from which one selection takes all
    wanted ranks.
    """

    def entry(measure: str, tier: Column, value: Column) -> Column:
        return F.struct(
            F.lit(measure).alias("measure"), tier.alias("tier"), value.cast(_EXACT).alias("value")
        )

    tier = F.coalesce("plan_tier", F.lit(""))
    measures = F.array(
        entry("fee", tier, F.when(~bad_fee(rules), F.col("monthly_fee_per_seat"))),
        entry("engagement", tier, F.col("engagement_score")),
        *[entry(c, F.lit(""), F.col(c)) for c in CAPPED],
    )
    # The fences for logins are taken after imputation, when the missing ones count as the median.
    missing = deduped.agg(F.count_if(F.col(LOGINS).isNull())).first()[0]
    filled = [r for p in QUARTILES for r in around(p, F.col("total") + missing)]
    ranks = F.array(*[r for p in QUARTILES for r in around(p)])
    ranks = F.when(
        F.col("measure") == LOGINS, F.concat(ranks, F.array(*filled, *[r - missing for r in filled]))
    ).otherwise(ranks)
    found = stage(
        values_at_ranks(deduped.select(F.inline(measures)), ["measure", "tier"], "value", ranks), "ranked"
    )

    known = interpolated(found, ["measure", "tier"], list(QUARTILES))
    tier_medians = stage(
        known.filter(F.col("measure").isin("fee", "engagement"))
        .groupBy("tier")
        .agg(
            *[
                F.max(F.when(F.col("measure") == m, F.col("quantiles")["0.5"])).alias(f"{m}_median")
                for m in ("fee", "engagement")
            ]
        ),
        "tier_medians",
    )
    # One row per capped column.
    quartiles = {
        r["measure"]: r["quantiles"]
        for r in known.filter(F.col("measure").isin(*CAPPED)).collect()
    }

    login_median = quartiles.get(LOGINS, {}).get("0.5")
    if login_median is not None and missing:
        # A dozen ranks of one column.
        at = {r["rank"]: r for r in found.filter(F.col("measure") == LOGINS).collect()}
        quartiles[LOGINS] = _quartiles_with_missing(at, missing, login_median.quantize(Decimal("0.0001")))
    fences = {}
    for c, q in quartiles.items():
        reach = rules.iqr_factor * (q["0.75"] - q["0.25"])
        fences[c] = Fences(q["0.25"] - reach, q["0.75"] + reach)
    return CleaningFit(tier_medians, login_median, fences)


def fix_impossible_dates(df: DataFrame) -> DataFrame:
    """A churn date before the start is dropped and the account counts as active.

    The churn reason is kept.
    """
    bad = bad_date()
    return df.withColumns(
        {
            "churn_date": F.when(~bad, F.col("churn_date")),
            "churned": F.when(bad, 0).otherwise(F.col("churned")),
        }
    )


def _with_tier_medians(df: DataFrame, fitted: CleaningFit) -> DataFrame:
    # A small staged file: Catalyst knows its size and broadcasts it on that ground.
    return df.withColumn("tier", F.coalesce("plan_tier", F.lit(""))).join(
        fitted.tier_medians, "tier", "left"
    )


def fix_fees(df: DataFrame, fitted: CleaningFit, rules: Rules = DEFAULT) -> DataFrame:
    """Fees below the minimum become the median of the tier's good fees."""
    fee = F.when(bad_fee(rules), F.col("fee_median")).otherwise(F.col("monthly_fee_per_seat"))
    return (
        _with_tier_medians(df, fitted)
        .withColumn("monthly_fee_per_seat", fee.cast("decimal(13,3)"))
        .select(*df.columns)
    )


def impute_engagement(df: DataFrame, fitted: CleaningFit) -> DataFrame:
    score = F.coalesce("engagement_score", "engagement_median")
    return (
        _with_tier_medians(df, fitted)
        .withColumn("engagement_score", score.cast("decimal(6,2)"))
        .select(*df.columns)
    )


def impute_logins(df: DataFrame, fitted: CleaningFit) -> DataFrame:
    median = F.lit(fitted.login_median).cast("decimal(18,4)")
    return df.withColumn(
        "monthly_logins_per_user", F.coalesce("monthly_logins_per_user", median)
    )


def cap_outliers(df: DataFrame, fitted: CleaningFit) -> DataFrame:
    """Clip to the fences; a fractional bound on tickets is truncated."""

    def capped(name: str) -> Column:
        col, f = F.col(name), fitted.fences[name]
        out = (
            F.when(col < F.lit(f.low), F.lit(f.low).cast(_EXACT))
            .when(col > F.lit(f.high), F.lit(f.high).cast(_EXACT))
            .otherwise(col.cast(_EXACT))
        )
        return out.cast(df.schema[name].dataType)

    return df.withColumns({c: capped(c) for c in CAPPED if c in fitted.fences})


def normalize_types(df: DataFrame) -> DataFrame:
    """Canonical columns and types; text that does not parse becomes null."""
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(CLEAN)
    return df.select(
        *[
            F.col(f.name).try_cast(f.dataType).alias(f.name)
            if f.name in df.columns
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in target
        ]
    )


def clean(raw: DataFrame, rules: Rules = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Cleaned accounts and the audit log."""
    deduped = stage(remove_duplicates(raw), "deduped")
    fitted = fit(deduped, rules)
    return apply(deduped, fitted, rules), audit_log(raw, deduped, fitted, rules)


def apply(deduped: DataFrame, fitted: CleaningFit, rules: Rules = DEFAULT) -> DataFrame:
    """All steps after de-duplication, in their fixed order, as one row-wise pass."""
    bad = bad_fee(rules)
    out = fix_impossible_dates(deduped)
    # Both tier medians come from the same small join.
    out = (
        _with_tier_medians(out, fitted)
        .withColumns(
            {
                "monthly_fee_per_seat": F.when(bad, F.col("fee_median"))
                .otherwise(F.col("monthly_fee_per_seat"))
                .cast("decimal(13,3)"),
                "engagement_score": F.coalesce("engagement_score", "engagement_median").cast(
                    "decimal(6,2)"
                ),
            }
        )
        .select(*deduped.columns)
    )
    return normalize_types(cap_outliers(impute_logins(out, fitted), fitted)).select(
        *column_names(CLEAN)
    )


def audit_log(
    raw: DataFrame, deduped: DataFrame, fitted: CleaningFit, rules: Rules = DEFAULT
) -> DataFrame:
    """One row per step that changed something: step_no, step, n_affected, message.

    De-duplication and type normalisation are always listed.
    """

    def money(value: Decimal | None) -> Column:
        return F.round(F.lit(value).cast(_EXACT), 2).cast("decimal(20,2)").cast("string")

    def outside(name: str) -> Column:
        value = F.col(name)
        if name == "monthly_logins_per_user":
            value = F.coalesce(value, F.lit(fitted.login_median).cast("decimal(18,4)"))
        f = fitted.fences.get(name)
        if f is None:
            return F.lit(0)
        return F.count_if((value < F.lit(f.low)) | (value > F.lit(f.high)))

    counts = deduped.agg(
        F.count("*").alias("kept"),
        F.count_if(bad_date()).alias("dates"),
        F.count_if(bad_fee(rules)).alias("fees"),
        F.count_if(F.col("engagement_score").isNull()).alias("scores"),
        F.count_if(F.col("monthly_logins_per_user").isNull()).alias("logins"),
        *[outside(c).alias(c) for c in CAPPED],
    ).withColumn("arrived", raw.agg(F.count("*")).scalar())

    def step(no: int, name: str, n: Column, *message) -> Column:
        parts = [m if isinstance(m, Column) else F.lit(m) for m in message]
        return F.struct(
            F.lit(no).alias("step_no"),
            F.lit(name).alias("step"),
            n.cast("bigint").alias("n_affected"),
            F.concat(*parts).alias("message"),
        )

    def text(n: Column) -> Column:
        return n.cast("bigint").cast("string")

    dropped = F.col("arrived") - F.col("kept")
    steps = [
        step(1, "dedup", dropped, "Deduplication: removed ", text(dropped),
             " duplicate rows (kept first per subscriber_id)"),
        step(2, "dates", F.col("dates"), "Date fix: ", text(F.col("dates")),
             " rows with churn_date before subscription_start_date"),
        step(3, "fees", F.col("fees"), "Fee fix: ", text(F.col("fees")),
             " fees below the minimum set to the plan-tier median"),
        step(4, "engagement", F.col("scores"), "Imputation: ", text(F.col("scores")),
             " null engagement_score set to the plan-tier median"),
        step(5, "logins", F.col("logins"), "Imputation: ", text(F.col("logins")),
             " null monthly_logins_per_user set to the median (",
             F.coalesce(money(fitted.login_median), F.lit("none")), ")"),
    ]
    for i, c in enumerate(CAPPED):
        f = fitted.fences.get(c)
        steps.append(
            step(6 + i, f"cap_{c}", F.col(c), f"Outlier cap ({c}): ", text(F.col(c)),
                 " values capped to [", money(f.low if f else None), ", ",
                 money(f.high if f else None), "]")
        )
    steps.append(step(9, "types", F.lit(0), "Type normalization"))
    return counts.select(F.inline(F.array(*steps))).filter(
        F.col("step").isin("dedup", "types") | (F.col("n_affected") > 0)
    )
