"""Readers and writers of the tables kept on storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from holdfast.operators.quality import report_lines
from holdfast.schemas import CLEAN, COMPARISON_FILE, FACT_MODEL_RUNS, PREDICTION_FILE, RAW_FILE


def _cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of CSV files as text, under the names of their header.

    Files of one path whose headers differ in names or order are an error, never read by position.
    """
    return spark.read.option("escape", '"').option("enforceSchema", "false").csv(path, header=True)


def _typed(cells: DataFrame, target: StructType) -> list[Column]:
    # Text first and a safe cast after, because a bad cell must not lose its whole row.
    present = set(cells.columns)
    return [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in target if f.name in present]


def read_text_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """CSV with a header; cells that do not parse become null instead of failing.

    Columns are found by name. One that the files lack is absent from the result, for
    ``quality.missing_columns`` to report; further ones are left out.
    """
    cells = _cells(spark, path)
    return cells.select(*_typed(cells, StructType.fromDDL(ddl)))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return read_text_table(spark, path, RAW_FILE)


def read_raw_in_file_order(spark: SparkSession, path: str) -> DataFrame:
    """Raw files that carry no ``ingest_seq``: their lines count as arrived in file order.

    The order is file, then position of the split, then line within the split; it needs
    no shuffle, and no pass over the data but for the header.
    """
    cells = _cells(spark, path)
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
    )
    fields = StructType([f for f in StructType.fromDDL(RAW_FILE) if f.name != "ingest_seq"])
    return cells.select(*_typed(cells, fields), position.alias("ingest_seq"))


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLEAN).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One part of a split table; the other parts' folders are not read."""
    return spark.read.parquet(path).filter(F.col("split") == split)


def _path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.globStatus(hadoop_path) is not None and len(fs.globStatus(hadoop_path)) > 0


def read_or_empty(spark: SparkSession, path: str, ddl: str, fmt: str = "csv") -> DataFrame:
    """The table at ``path``; no rows when there is none yet."""
    if not _path_exists(spark, path):
        return spark.createDataFrame([], ddl)
    if fmt == "csv":
        return read_text_table(spark, path, ddl)
    return spark.read.schema(ddl).format(fmt).load(path)


def read_predictions(spark: SparkSession, path: str, model_name: str) -> DataFrame:
    return read_or_empty(spark, f"{path}/model_name={model_name}", PREDICTION_FILE, "parquet")


def read_comparison(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, COMPARISON_FILE)


def write_raw(df: DataFrame, path: str) -> None:
    """Never overwrites what has been ingested."""
    df.write.mode("errorifexists").option("escape", '"').csv(path, header=True)


def write_clean(df: DataFrame, log: DataFrame, path: str, log_path: str) -> None:
    df.write.mode("overwrite").parquet(path)
    # Nine lines at most; one file keeps their order.
    log.orderBy("step_no").coalesce(1).select("message").write.mode("overwrite").text(log_path)


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Folders per part; ``df`` has a ``split`` column."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Folders per model."""
    df.select("subscriber_id", "churn_probability", "churned_actual", "model_name").write.mode(
        "overwrite"
    ).partitionBy("model_name").parquet(path)


def write_comparison(df: DataFrame, path: str) -> None:
    # One row per model.
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_quality_report(report: DataFrame, json_path: str, text_path: str) -> None:
    """``report`` is the single nested row; written as JSON and as readable lines."""
    report.write.mode("overwrite").json(json_path)
    lines = report_lines(report)
    lines.coalesce(1).sortWithinPartitions("line_no").select("value").write.mode("overwrite").text(
        text_path
    )


def write_table(df: DataFrame, path: str) -> None:
    """A warehouse table, to a path that is not being read."""
    df.write.mode("errorifexists").parquet(path)


def append_run(run: DataFrame, path: str) -> None:
    """One provenance row per training run."""
    columns = [f.name for f in StructType.fromDDL(FACT_MODEL_RUNS)]
    run.select(*columns).write.mode("append").parquet(path)


def export_watchlist(df: DataFrame, path: str) -> None:
    """The filtered list as CSV files, one per task."""
    df.write.mode("overwrite").csv(path, header=True)


def run_id(model_name: str, at: Column) -> Column:
    return F.concat(F.lit(f"{model_name}_"), F.date_format(at, "yyyyMMdd'T'HHmmss"))


def report_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct(*report.columns)).alias("value"))
