import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from holdfast.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "holdfast-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def accounts(spark):
    """Builds raw account rows from partial dicts."""
    from datetime import date
    from decimal import Decimal

    from pyspark.sql.types import StructType

    from holdfast.schemas import RAW

    schema = StructType.fromDDL(RAW)
    default = {
        "subscription_start_date": date(2023, 1, 15),
        "plan_tier": "starter",
        "billing_cycle": "monthly",
        "region": "NAM",
        "acquisition_channel": "organic",
        "industry_vertical": "Education",
        "monthly_fee_per_seat": Decimal("29.990"),
        "seat_count": 3,
        "total_contract_value": Decimal("89.9700"),
        "contract_months": 1,
        "tenure_months": 12,
        "engagement_score": Decimal("65.00"),
        "support_tickets_90d": 1,
        "payment_failures_12m": 0,
        "n_integrations": 3,
        "monthly_logins_per_user": Decimal("15.0000"),
        "feature_adoption_rate": Decimal("0.500"),
        "churned": 0,
    }

    def build(*rows):
        out = []
        for i, row in enumerate(rows):
            full = {f.name: None for f in schema} | default
            full |= {"subscriber_id": f"SUB-{i:06d}", "ingest_seq": i} | row
            out.append(tuple(full[f.name] for f in schema))
        return spark.createDataFrame(out, schema)

    return build
