"""Rule values used across the package."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

# Allowed codes, limits, labels and thresholds.
PLAN_TIERS = ("starter", "growth", "professional", "enterprise")
BILLING_CYCLES = ("monthly", "annual")
REGION_CODES = ("APAC", "EMEA", "LATAM", "NAM")
CHANNELS = ("organic", "paid_search", "referral", "partner", "direct_sales", "trial_convert")
RISK_TIERS = ("high", "medium", "low")
HIGH_CHURN_INDUSTRIES = ("E-commerce", "Media & Entertainment")


@dataclass(frozen=True)
class Rules:
    fee_min: Decimal = Decimal("9.99")
    fee_max: Decimal = Decimal("999.99")
    contract_min: int = 1
    contract_max: int = 36
    seats_min: int = 1
    seats_max: int = 500
    failures_max: int = 12
    iqr_factor: int = 3
    test_share: Decimal = Decimal("0.20")
    val_share: Decimal = Decimal("0.15")
    folds: int = 5
    seed: int = 42
    threshold: float = 0.40
    high_risk: float = 0.70
    medium_risk: float = 0.40
    watchlist_size: int = 500
    page_size: int = 25
    histogram_bins: int = 40
    save_rate: Decimal = Decimal("0.30")
    primary_model: str = "gradient_boost"


DEFAULT = Rules()
