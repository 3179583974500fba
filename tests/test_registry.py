import pytest

import __spark_entry__ as entry_points
from checks.compare import differences, open_duckdb
from checks.oracle import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return open_duckdb(SF)


def test_names():
    names = set(entry_points.queries())
    assert set(ORACLE) <= names


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() == 4 and "plan_tier" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    assert differences(entry_points.queries()[name](spark, SF), duck, ORACLE[name]) is None
