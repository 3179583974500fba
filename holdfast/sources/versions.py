"""Versioned output: every run writes a folder of its own, and one row says which one counts.

A version is written below ``<root>/versions`` and becomes the current one by one appended row in
``<root>/published``, committed as a whole or not at all. Readers take the version of the highest
number. A run that fails leaves its folder unpublished, and readers stay with the version before. Old
versions are deleted by ``expire``, which keeps the newest ones. Of two runs that publish at the
same time both are kept, and the one with the later row counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLISHED = "number bigint, version string, published_at timestamp"


def published(spark: SparkSession, root: str) -> DataFrame:
    """All published versions; no rows before the first."""
    try:
        return spark.read.schema(PUBLISHED).parquet(f"{root}/published")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PUBLISHED)


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the version that counts, None before the first."""
    row = published(spark, root).orderBy(F.desc("number"), F.desc("published_at"), F.desc("version")).first()
    return None if row is None else f"{root}/versions/{row['version']}"


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Makes a written version the current one."""
    last = published(spark, root).agg(F.coalesce(F.max("number"), F.lit(0)).alias("n")).first()["n"]
    row = spark.range(1).select(
        F.lit(last + 1).cast("bigint").alias("number"), F.lit(version).alias("version"),
        F.current_timestamp().alias("published_at"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{root}/published")


def write_version(spark: SparkSession, root: str, write: Callable[[str, str | None], Any]) -> Any:
    """Calls ``write`` with a fresh folder and the current one, then publishes the fresh one.

    Returns what ``write`` returns. If it raises, nothing is published.
    """
    before = current(spark, root)
    version = uuid.uuid4().hex
    out = write(f"{root}/versions/{version}", before)
    publish(spark, root, version)
    return out


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Deletes the folders of all published versions but the newest ``keep``; returns their names.

    Unpublished folders stay, as a run may be writing them.
    """
    if keep < 1:
        raise ValueError("the current version must stay")
    rows = published(spark, root).orderBy(F.desc("number"), F.desc("published_at"), F.desc("version")).collect()
    gone = []
    for row in rows[keep:]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{row['version']}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True):
            gone.append(row["version"])
    return gone
