"""Model features of cleaned accounts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.business import annual_revenue, plan_ordinal
from holdfast.functions.exact import clip
from holdfast.operators.categories import category_index, category_sizes
from holdfast.operators.selection import quantiles

# Column lists and the data dictionary.
LEAKAGE_COLUMNS = (
    "churn_probability_true", "churn_date", "churn_reason", "subscription_start_date",
)
NUMERIC_FEATURES = (
    "monthly_fee_per_seat", "seat_count", "contract_months", "tenure_months",
    "engagement_score", "support_tickets_90d", "payment_failures_12m",
    "n_integrations", "monthly_logins_per_user", "feature_adoption_rate",
    "plan_tier_enc", "monthly_arr_usd", "fee_per_seat_log", "seat_count_log",
    "tenure_log", "engagement_decile", "risk_score_simple",
    "seats_x_engagement", "log_arr_x_tenure",
)
CATEGORICAL_FEATURES = ("plan_tier", "region", "acquisition_channel", "industry_vertical")
BINARY_FEATURES = (
    "billing_annual_flag", "is_high_ticket_user", "is_payment_delinquent",
    "is_low_adoption", "channel_is_organic", "channel_is_referral",
)
LABEL = "churned"
CATALOG = {
    "plan_tier": "Subscription plan",
    "billing_cycle": "Monthly or annual billing",
    "region": "Region of the account",
    "acquisition_channel": "How the subscriber was won",
    "industry_vertical": "Business vertical",
    "monthly_fee_per_seat": "Monthly fee per seat in USD",
    "seat_count": "Licensed seats",
    "contract_months": "Contract length in months",
    "tenure_months": "Months since the start",
    "engagement_score": "Platform engagement 0-100",
    "support_tickets_90d": "Support tickets of the last 90 days",
    "payment_failures_12m": "Failed payments of the last 12 months",
    "n_integrations": "Enabled integrations",
    "monthly_logins_per_user": "Mean logins per user and month",
    "feature_adoption_rate": "Share of features in use, 0-1",
    "plan_tier_enc": "Plan as a number, lowest tier 0",
    "billing_annual_flag": "1 when billed annually",
    "monthly_arr_usd": "Fee x seats x 12",
    "fee_per_seat_log": "log(1 + fee)",
    "seat_count_log": "log(1 + seats)",
    "tenure_log": "log(1 + tenure)",
    "engagement_decile": "Decile 1-10 of the engagement score",
    "risk_score_simple": "0.4 low engagement + 0.3 failures + 0.3 tickets, 0-1",
    "is_high_ticket_user": "More than 3 tickets",
    "is_payment_delinquent": "At least 2 failed payments",
    "is_low_adoption": "Adoption below 0.25",
    "seats_x_engagement": "Seats x engagement",
    "log_arr_x_tenure": "log(1 + revenue) x log(1 + tenure)",
    "channel_is_organic": "1 for the organic channel",
    "channel_is_referral": "1 for the referral channel",
}

_DECILES = [str(i / 10) for i in range(11)]


def fit_decile_edges(df: DataFrame) -> list:
    """Distinct ten-quantile edges of the engagement score, at most eleven numbers."""
    row = quantiles(df, [], "engagement_score", _DECILES).first()
    return sorted(set(row["quantiles"].values())) if row else []


def apply_decile(score: Column, edges: list) -> Column:
    """Right-closed bin number from 1; null for a null score or fewer than two edges."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    inner = [F.lit(e) for e in edges[1:-1]]
    above = sum(((score > e).cast("int") for e in inner), F.lit(1))
    return F.when(score.isNotNull(), above).cast("int")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def build_features(df: DataFrame, edges: list | None = None) -> DataFrame:
    """Feature columns next to the account key and the label.

    Pass the ``edges`` learned on the training rows to score other rows with them;
    without, they are learned from ``df`` itself.
    """
    edges = fit_decile_edges(df) if edges is None else edges
    c = F.col
    risk = (
        F.lit(0.40).cast("decimal(3,2)") * (1 - clip(c("engagement_score"), 0, 100) / F.lit(100))
        + F.lit(0.30).cast("decimal(3,2)") * clip(c("payment_failures_12m"), 0, 4).cast("decimal(4,0)") / F.lit(4)
        + F.lit(0.30).cast("decimal(3,2)") * clip(c("support_tickets_90d"), 0, 5).cast("decimal(4,0)") / F.lit(5)
    )
    out = df.drop(*LEAKAGE_COLUMNS).withColumns(
        {
            "plan_tier_enc": plan_ordinal(c("plan_tier")),
            "billing_annual_flag": _flag(c("billing_cycle") == "annual"),
            "monthly_arr_usd": annual_revenue(c("monthly_fee_per_seat"), c("seat_count")),
            "fee_per_seat_log": F.log1p(c("monthly_fee_per_seat").cast("double")),
            "seat_count_log": F.log1p(c("seat_count").cast("double")),
            "tenure_log": F.log1p(c("tenure_months").cast("double")),
            "engagement_decile": apply_decile(c("engagement_score"), edges),
            "risk_score_simple": F.bround(risk, 4).cast("double"),
            "is_high_ticket_user": _flag(c("support_tickets_90d") > 3),
            "is_payment_delinquent": _flag(c("payment_failures_12m") >= 2),
            "is_low_adoption": _flag(c("feature_adoption_rate") < 0.25),
            "seats_x_engagement": F.bround(
                c("seat_count") * c("engagement_score"), 2
            ).cast("decimal(18,2)"),
            "channel_is_organic": _flag(c("acquisition_channel") == "organic"),
            "channel_is_referral": _flag(c("acquisition_channel") == "referral"),
        }
    )
    out = out.withColumn(
        "log_arr_x_tenure",
        F.bround(F.log1p(c("monthly_arr_usd").cast("double")) * c("tenure_log"), 4),
    )
    texts = ("plan_tier", "billing_cycle", "region", "acquisition_channel", "industry_vertical")
    return out.withColumns({t: F.lower(F.trim(t)) for t in texts})


def with_comments(features: DataFrame) -> DataFrame:
    """The data dictionary attached to the columns as metadata."""
    for name, text in CATALOG.items():
        if name in features.columns:
            features = features.withMetadata(name, {"comment": text})
    return features


def available(df: DataFrame, names) -> list[str]:
    return [n for n in names if n in df.columns]


@dataclass(frozen=True)
class Preparation:
    """What scaling and encoding learned from the training rows.

    The category values stay a table, ``index``; the driver holds their number per column.
    """

    scales: dict[str, tuple[float, float]]
    index: DataFrame
    sizes: dict[str, int]
    binary: tuple[str, ...]
    n_rows: int
    n_positive: int

    @cached_property
    def categories(self) -> dict[str, list[str]]:
        """The values themselves, for results that name a column after each; collected on demand."""
        found: dict[str, list[str]] = {c: [] for c in self.sizes}
        for row in self.index.orderBy("name", "position").collect():
            found[row["name"]].append(row["value"])
        return found

    def scaled_names(self) -> list[str]:
        return [f"{c}_scaled" for c in self.scales]

    def encoded_names(self) -> list[str]:
        return [n for c in self.categories for n in one_hot_names(c, self.categories[c])]


def one_hot_names(column: str, values: list[str]) -> list[str]:
    def clean(value: str) -> str:
        return "".join(ch if ch.isalnum() else "_" for ch in value)

    names = [f"{column}_{clean(v)}" for v in values[1:]]
    if len(set(names)) < len(names):
        names = [f"{n}_{i}" for i, n in enumerate(names, 1)]
    return names


def fit_preparation(df: DataFrame, max_categories: int | None = None) -> Preparation:
    """Mean and population deviation per numeric column, index of the values of the text columns.

    The sizes of the classes come from the same pass over the rows. ``max_categories`` times the
    columns refuses more distinct values.
    """
    numeric = available(df, NUMERIC_FEATURES)
    label = F.col(LABEL) if LABEL in df.columns else F.lit(0)
    filled = df.select(
        label.alias("label"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric],
    )
    row = filled.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("label") == 1).alias("n_positive"),
        *[F.avg(c).alias(f"{c}_mean") for c in numeric],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in numeric],
    ).first()
    scales = {c: (row[f"{c}_mean"] or 0.0, row[f"{c}_std"] or 1.0) for c in numeric}

    cats = available(df, CATEGORICAL_FEATURES)
    index = category_index(df, cats)
    sizes = category_sizes(index, cats)
    if max_categories is not None and sum(sizes.values()) > max_categories * len(cats):
        raise ValueError(f"more than {max_categories * len(cats)} category values; encode such columns differently")
    return Preparation(
        scales, index, sizes, tuple(available(df, BINARY_FEATURES)), row["n_rows"], row["n_positive"]
    )


def scaled_columns(prep: Preparation) -> dict[str, Column]:
    """Missing numbers count as 0; a constant column becomes 0."""
    return {
        f"{c}_scaled": (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(mean)) / F.lit(std)
        for c, (mean, std) in prep.scales.items()
    }


def one_hot_columns(prep: Preparation) -> dict[str, Column]:
    """0/1 column per value but the first; an unseen value is 0 everywhere. For columns of few values."""
    return {
        name: F.col(c).eqNullSafe(F.lit(value)).cast("int")
        for c, values in prep.categories.items()
        for name, value in zip(one_hot_names(c, values), values[1:])
    }


def label_index_columns(prep: Preparation) -> dict[str, Column]:
    """Position in alphabetical order; an unseen value is an error. For columns of few values."""
    out = {}
    for c, values in prep.categories.items():
        lookup = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])
        found = F.try_element_at(lookup, F.coalesce(F.col(c), F.lit(values[0])))
        out[f"{c}_index"] = F.coalesce(
            found, F.raise_error(F.concat(F.lit(f"unseen {c}: "), F.col(c))).cast("int")
        )
    return out
