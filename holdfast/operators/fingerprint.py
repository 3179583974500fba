"""Content fingerprint of a table that ignores row order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.exact import hash_key


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: n_rows and a 16-digit hex hash of all row contents."""
    names = columns or df.columns
    # Each value with its length, so that no two rows read alike; null has none.
    texts = [F.col(c).cast("string") for c in names]
    row = F.concat_ws(
        "|", *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("~")) for t in texts]
    )
    total = F.coalesce(F.sum(hash_key(row).cast("decimal(28,0)")), F.lit(0))
    return df.agg(F.count("*").alias("n_rows"), total.alias("row_sum")).select(
        "n_rows",
        F.substring(
            F.sha2(
                F.concat(F.col("row_sum").cast("string"), F.lit("|"), F.col("n_rows").cast("string")),
                256,
            ),
            1,
            16,
        ).alias("data_hash"),
    )
