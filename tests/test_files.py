import json
from decimal import Decimal as D

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from holdfast.operators import cleaning, quality
from holdfast.schemas import COMPARISON_FILE, FACT_MODEL_RUNS, RAW, column_names
from holdfast.session import scratch_dir, stage
from holdfast.sources import files


def test_raw_file_is_never_overwritten(accounts, tmp_path, spark):
    raw = accounts({}, {"industry_vertical": 'a "b", c', "engagement_score": None})
    path = str(tmp_path / "raw")
    files.write_raw(raw, path)
    got = files.read_raw(spark, path).select(*[F.col(n).cast(t) for n, t in raw.dtypes])
    assert sorted(map(str, got.collect())) == sorted(map(str, raw.collect()))
    with pytest.raises(AnalysisException):
        files.write_raw(raw, path)


def test_cells_that_do_not_parse_become_null(spark, tmp_path):
    target = tmp_path / "bad.csv"
    columns = column_names(RAW)
    row = {c: "" for c in columns} | {"subscriber_id": "A", "seat_count": "many", "churned": "1",
                                      "subscription_start_date": "2023-02-31"}
    target.write_text(",".join(columns) + "\n" + ",".join(row[c] for c in columns) + "\n")
    got = files.read_raw(spark, str(target)).first()
    assert got["subscriber_id"] == "A" and got["churned"] == 1
    assert got["seat_count"] is None and got["subscription_start_date"] is None


def test_columns_are_found_by_name(spark, accounts, tmp_path):
    raw = accounts({"feature_adoption_rate": D("0.123"), "billing_cycle": "annual"})
    shuffled = raw.select(*reversed(raw.columns)).drop("seat_count").withColumn("note", F.lit("x"))
    shuffled = shuffled.withColumn("feature_adoption_rate", F.lit("12.5"))
    files.write_raw(shuffled, str(tmp_path / "raw"))
    got = files.read_raw(spark, str(tmp_path / "raw"))
    assert got.columns == [c for c in raw.columns if c != "seat_count"]
    row = got.first()
    assert (row["plan_tier"], row["billing_cycle"], row["contract_months"]) == ("starter", "annual", 1)
    assert quality.missing_columns(got) == ["seat_count"]
    found = {(r["column_name"], r["rule"]) for r in quality.violations(got).collect()}
    assert ("feature_adoption_rate", "above_maximum") in found


def test_files_with_different_headers_are_refused(spark, accounts, tmp_path):
    raw = accounts({})
    for i, columns in enumerate((raw.columns, raw.columns[::-1])):
        raw.select(*columns).toPandas().to_csv(tmp_path / f"{i}.csv", index=False)
    with pytest.raises(Exception, match="(?i)header"):
        files.read_raw(spark, str(tmp_path)).collect()


def test_files_without_arrival_numbers_keep_their_first_lines(spark, accounts, tmp_path):
    rows = [{"subscriber_id": f"S{i % 500}", "seat_count": i + 1} for i in range(3000)]
    target = tmp_path / "raw.csv"
    accounts(*rows).drop("ingest_seq").toPandas().to_csv(target, index=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        raw = files.read_raw_in_file_order(spark, str(target))
        assert raw.rdd.getNumPartitions() > 3
        out, _ = cleaning.clean(raw)
        got = {r["subscriber_id"]: r["seat_count"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"S{i}": i + 1 for i in range(500)}


def test_missing_files_read_as_empty(spark, tmp_path):
    assert files.read_comparison(spark, str(tmp_path / "none")).columns[:2] == ["model", "roc_auc"]
    assert files.read_predictions(spark, str(tmp_path / "none"), "m").count() == 0


def test_predictions_by_model(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", 0.1, 0, "x"), ("a", 0.2, 0, "y")],
        "subscriber_id string, churn_probability double, churned_actual int, model_name string",
    )
    files.write_predictions(df, str(tmp_path / "p"))
    assert [r["churn_probability"] for r in files.read_predictions(spark, str(tmp_path / "p"), "y").collect()] == [0.2]


def test_comparison_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.5, 0.2, 0.1, 0.3, 0.4, 0.4)], COMPARISON_FILE)
    files.write_comparison(df, str(tmp_path / "c"))
    assert files.read_comparison(spark, str(tmp_path / "c")).collect() == df.collect()


def test_clean_and_log(accounts, spark, tmp_path):
    out, log = cleaning.clean(accounts({}, {"subscriber_id": "SUB-000000"}))
    files.write_clean(out, log, str(tmp_path / "clean"), str(tmp_path / "log"))
    assert files.read_clean(spark, str(tmp_path / "clean")).count() == 1
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert lines[0].startswith("Deduplication: removed 1 ")


def test_quality_report_files(accounts, spark, tmp_path):
    files.write_quality_report(
        quality.report(accounts({}, {})), str(tmp_path / "json"), str(tmp_path / "text")
    )
    part = next((tmp_path / "json").glob("*.json"))
    nested = json.loads(part.read_text())
    assert nested["n_rows"] == 2 and len(nested["columns"]) == 15
    assert spark.read.text(str(tmp_path / "text")).first()["value"].startswith("Rows: 2")
    as_text = files.report_json(quality.report(accounts({}))).first()["value"]
    assert json.loads(as_text)["n_rows"] == 1


def test_split_folder_is_pruned(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "subscriber_id string, split string")
    files.write_splits(df, str(tmp_path / "s"))
    got = files.read_split(spark, str(tmp_path / "s"), "test")
    assert [r["subscriber_id"] for r in got.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(split" in got._jdf.queryExecution().executedPlan().toString()


def test_runs_are_appended(spark, tmp_path):
    run = spark.createDataFrame([("r",) + (None,) * 12], FACT_MODEL_RUNS)
    files.append_run(run, str(tmp_path / "runs"))
    files.append_run(run, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_run_id_text(spark):
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    assert spark.range(1).select(files.run_id("m", at)).first()[0] == "m_20240506T070809"


def test_staged_tables_live_in_the_shared_folder(spark):
    staged = stage(spark.range(5), "five")
    assert scratch_dir(spark) in staged.inputFiles()[0]
    assert staged.count() == 5


class _Session:
    """Just what scratch_dir asks of a session."""

    def __init__(self, master, configured=None):
        self.conf = {"spark.checkpoint.dir": configured}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app"})


def test_a_cluster_needs_a_configured_folder():
    assert scratch_dir(_Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(_Session("yarn"))
