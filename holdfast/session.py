"""Spark session for local runs, and staging of shared intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PARTITION_BYTES = 4 << 20  # of compressed files; some 20 times as much in a sort or hash table
_local_scratch: dict[str, str] = {}
_dealt: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "holdfast") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def deal_by_size(spark: SparkSession, n_bytes: int) -> None:
    """Shuffles start with a partition per ``PARTITION_BYTES`` of the input files, where that is more than the session's.

    A task's memory then stays the same as the input grows: adaptive execution puts small partitions together
    only up to its advisory size. A number that the caller has set for the start stays.
    """
    name, app = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", spark.sparkContext.applicationId
    now = spark.conf.get(name, None)
    if now is not None and now != _dealt.get(app):
        return
    n = -(-n_bytes // PARTITION_BYTES)
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
        _dealt[app] = str(n)
        spark.conf.set(name, _dealt[app])
    else:
        spark.conf.unset(name)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors would each see their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="holdfast-")
    return _local_scratch[app]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """For learners that cut their lineage by checkpoints; a configured folder stays."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Used where several branches read the same expensive frame. The scan keeps
    column pruning, gives Catalyst a real size for its join choice, and survives
    the loss of executors because nothing has to be recomputed.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_evenly(df: DataFrame, name: str) -> DataFrame:
    """``stage`` in equal parts, one per core: a learner's every pass waits for the longest task."""
    return stage(df.repartition(df.sparkSession.sparkContext.defaultParallelism), name)
