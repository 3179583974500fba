"""Column layouts of the tables that are read, written and loaded."""

from __future__ import annotations

import re

_ACCOUNT_BODY = """
    subscriber_id string, subscription_start_date date, plan_tier string, billing_cycle string,
    region string, acquisition_channel string, industry_vertical string,
    monthly_fee_per_seat decimal(13,3), seat_count int, total_contract_value decimal(20,4),
    contract_months int, tenure_months int, engagement_score decimal(6,2),
    support_tickets_90d int, payment_failures_12m int, n_integrations int,
    monthly_logins_per_user decimal(18,4), feature_adoption_rate decimal(4,3),
    churned int, churn_date date, churn_reason string, churn_probability_true double
"""

# Fees, scores and logins carry the extra digits that medians and caps can need.
CLEAN = _ACCOUNT_BODY
RAW = _ACCOUNT_BODY + ", ingest_seq bigint"
# Files are read wide, so that a value out of range is seen by the rules before types are narrowed.
RAW_FILE = re.sub(r"decimal\(\d+,\d+\)", "decimal(30,10)", RAW)

DIM_PLAN = """plan_id int, plan_tier string, tier_rank int, base_price_floor decimal(12,2),
    base_price_ceil decimal(12,2), description string"""
DIM_REGION = "region_id int, region_code string, region_name string"
DIM_CHANNEL = "channel_id int, channel_code string, channel_type string"
DIM_INDUSTRY = "industry_id int, industry_name string"

FACT_SUBSCRIBERS = """
    subscriber_id string, plan_id int, region_id int, channel_id int, industry_id int,
    subscription_start_date date, billing_cycle string, contract_months int, tenure_months int,
    monthly_fee_per_seat decimal(13,3), seat_count int, total_contract_value decimal(20,4),
    monthly_arr_usd decimal(18,2), engagement_score decimal(6,2), support_tickets_90d int,
    payment_failures_12m int, n_integrations int, monthly_logins_per_user decimal(18,4),
    feature_adoption_rate decimal(4,3), churned int, churn_date date, churn_reason string
"""
FACT_PREDICTIONS = """
    subscriber_id string, model_name string, run_id string, churn_probability double,
    predicted_churned int, risk_tier string, predicted_at timestamp
"""
FACT_MODEL_RUNS = """
    run_id string, model_name string, trained_at timestamp, data_hash string, n_train bigint,
    n_test bigint, roc_auc double, pr_auc double, f1_score double, precision_score double,
    recall_score double, threshold_used double, artifact_path string
"""
PREDICTION_FILE = "subscriber_id string, churn_probability double, churned_actual int"
COMPARISON_FILE = """model string, roc_auc double, pr_auc double, f1 double, precision double,
    recall double, threshold double"""


def column_names(ddl: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).names
