"""Versioned runs: a second run on one output, and a run that fails."""

import pytest
from pyspark.sql import functions as F

from holdfast.plans import full_run, models
from holdfast.sources import versions
from holdfast.sources.accounts import MARKET_SEGMENTS
from holdfast.workspace import open_workspace

SF = "/root/testdata/sf0.001"
SETTINGS = {
    "industries": MARKET_SEGMENTS, "cross_validation": False,
    "trainers": {"logistic_regression": models.train_logistic},
}


def write(spark, n):
    def to(path, previous):
        old = spark.read.parquet(f"{previous}/t").count() if previous else 0
        spark.range(old + n).write.parquet(f"{path}/t")
        if n < 0:
            raise RuntimeError("stopped half-way")
        return old

    return to


def rows(spark, root):
    return spark.read.parquet(f"{versions.current(spark, root)}/t").count()


def test_versions_follow_each_other(spark, tmp_path):
    root = str(tmp_path / "out")
    assert versions.current(spark, root) is None
    assert versions.write_version(spark, root, write(spark, 3)) == 0
    first = versions.current(spark, root)
    assert versions.write_version(spark, root, write(spark, 4)) == 3
    assert rows(spark, root) == 7 and versions.current(spark, root) != first
    assert [r["number"] for r in versions.published(spark, root).orderBy("number").collect()] == [1, 2]


def test_a_failed_run_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path / "out")
    versions.write_version(spark, root, write(spark, 3))
    with pytest.raises(RuntimeError):
        versions.write_version(spark, root, write(spark, -2))
    assert rows(spark, root) == 3
    assert versions.write_version(spark, root, write(spark, 2)) == 3 and rows(spark, root) == 5


def test_old_versions_expire(spark, tmp_path):
    root = str(tmp_path / "out")
    for _ in range(4):
        versions.write_version(spark, root, write(spark, 1))
    held = {r["number"]: r["version"] for r in versions.published(spark, root).collect()}
    assert set(versions.expire(spark, root, keep=2)) == {held[1], held[2]}
    assert {p.name for p in (tmp_path / "out" / "versions").iterdir()} == {held[3], held[4]}
    assert rows(spark, root) == 4 and versions.expire(spark, root, keep=2) == []
    with pytest.raises(ValueError):
        versions.expire(spark, root, keep=0)


def test_two_runs_on_one_output(spark, tmp_path):
    w, root = open_workspace(spark, SF), str(tmp_path / "out")
    some = w.raw.filter(F.crc32("subscriber_id") % 4 != 0)
    full_run.run_again(some, root, **SETTINGS)
    first = full_run.open_version(spark, root, MARKET_SEGMENTS)
    n_some = some.select("subscriber_id").distinct().count()
    assert first.fact.count() == first.predictions.count() == n_some
    rest = w.raw.filter(F.crc32("subscriber_id") % 4 < 2)
    full_run.run_again(rest, root, **SETTINGS)
    both = some.union(rest).select("subscriber_id").distinct().count()
    second = full_run.open_version(spark, root, MARKET_SEGMENTS)
    assert second.fact.count() == second.predictions.count() == both > n_some
    runs = spark.read.parquet(f"{versions.current(spark, root)}/warehouse/fact_model_runs")
    assert runs.count() == 4 and runs.select("trained_at").distinct().count() == 2
    assert first.fact.count() == n_some  # the version before stays readable
