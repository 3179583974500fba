"""Exact order statistics that never sort a whole column in one task.

Values are first counted (map-side combined), so repeats cost nothing. The distinct
values fall into ordered coarse buckets. Bucket totals - a small table - tell which
bucket holds a wanted rank; only those buckets are walked value by value.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.operators.joins import join_own_aggregate


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Columns: the groups, ``value``, ``n``. Nulls are left out."""
    return (
        df.select(*groups, F.col(value).alias("value"))
        .filter("value IS NOT NULL")
        .groupBy(*groups, "value")
        .agg(F.count("*").alias("n"))
    )


def log_bucket(value: Column) -> Column:
    """Order-keeping bucket, about one percent wide relative to the value."""
    size = F.floor(F.log2(F.abs(value.cast("double")) * 10_000 + 1) * 64)
    return (F.signum(value.cast("double")) * size).cast("int")


def with_positions(counts: DataFrame, groups: list[str], bucket: Column) -> DataFrame:
    """Adds ``bucket``, ``start`` (rows before this value) and ``total`` to value counts.

    Windows run over bucket totals, and over the distinct values of one bucket.
    """
    keyed = counts.withColumn("bucket", bucket)
    totals = _bucket_totals(keyed, groups)
    return (
        join_own_aggregate(keyed, totals, [*groups, "bucket"])
        .withColumn("start", F.col("before") + _running(groups, "value"))
        .drop("before", "in_bucket")
    )


def _running(groups: list[str], order: str) -> Column:
    walk = Window.partitionBy(*groups, "bucket").orderBy(order)
    return F.sum("n").over(walk.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")


def _bucket_totals(keyed: DataFrame, groups: list[str]) -> DataFrame:
    by_group = Window.partitionBy(*groups)
    upto = by_group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return (
        keyed.groupBy(*groups, "bucket")
        .agg(F.sum("n").alias("in_bucket"))
        .withColumn("before", F.sum("in_bucket").over(upto) - F.col("in_bucket"))
        .withColumn("total", F.sum("in_bucket").over(by_group))
    )


def values_at_ranks(
    counts: DataFrame, groups: list[str], ranks: Column, bucket: Column
) -> DataFrame:
    """Value at each 0-based rank. Columns: the groups, ``total``, ``rank``, ``at_rank``.

    ``ranks`` is an array expression over ``total``, the number of rows of the group.
    """
    keyed = counts.withColumn("bucket", bucket)
    wanted = (
        _bucket_totals(keyed, groups)
        .withColumn(
            "ranks",
            F.filter(
                F.array_distinct(ranks),
                lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("in_bucket")),
            ),
        )
        .filter(F.size("ranks") > 0)
        .select(*groups, "bucket", "before", "total", "ranks")
    )
    return (
        join_own_aggregate(keyed, wanted, [*groups, "bucket"])
        .withColumn("start", F.col("before") + _running(groups, "value"))
        .withColumn(
            "rank",
            F.explode(
                F.filter(
                    "ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n"))
                )
            ),
        )
        .select(*groups, "total", "rank", F.col("value").alias("at_rank"))
    )


def exact_quantiles(
    counts: DataFrame,
    groups: list[str],
    probs: list[str],
    bucket: Column | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles of value counts.

    Columns: the groups and ``quantiles``, a map from the probability as given to a
    ``decimal(24,4)``. Probabilities are decimal text such as ``"0.25"``.
    """
    bucket = log_bucket(F.col("value")) if bucket is None else bucket

    def position(p: str) -> Column:
        return (F.col("total") - 1).cast("decimal(18,0)") * F.lit(Decimal(p)).cast("decimal(5,4)")

    def low(p: str) -> Column:
        return F.floor(position(p)).cast("bigint")

    def high(p: str) -> Column:
        return F.ceil(position(p)).cast("bigint")

    ranks = F.array(*[f(p) for p in probs for f in (low, high)])
    # At most two entries per probability reach the map of a group.
    found = (
        values_at_ranks(counts, groups, ranks, bucket)
        .groupBy(*groups)
        .agg(
            F.max("total").alias("total"),
            F.map_from_entries(F.collect_list(F.struct("rank", "at_rank"))).alias("at"),
        )
        .filter("total IS NOT NULL")
    )

    def quantile(p: str) -> Column:
        at_low = F.element_at("at", low(p)).cast("decimal(20,4)")
        at_high = F.element_at("at", high(p)).cast("decimal(20,4)")
        part = (position(p) - low(p)).cast("decimal(5,4)")
        return (at_low + (at_high - at_low) * part).cast("decimal(24,4)")

    pairs = [x for p in probs for x in (F.lit(p), quantile(p))]
    return found.select(*groups, F.create_map(*pairs).alias("quantiles"))


def tile_summary(df: DataFrame, groups: list[str], value: str, tiles: int) -> DataFrame:
    """Count, minimum, maximum and sum of ``value`` in each of ``tiles`` equal slices.

    Gives what NTILE over the ordered rows would give after aggregation. Rows with the
    same value are interchangeable for these measures, so only the value counts are
    walked, and a value that straddles a border is split by its count.
    """
    counts = value_counts(df, groups, value)
    placed = with_positions(counts, groups, log_bucket(F.col("value")))
    base = F.call_function("div", F.col("total"), F.lit(tiles))
    extra = F.col("total") % tiles
    t = F.col("tile") - 1
    # The first ``extra`` tiles hold one row more than the others.
    tile_start = t * base + F.least(t, extra)
    tile_size = base + F.when(t < extra, 1).otherwise(0)
    overlap = F.least(F.col("start") + F.col("n"), tile_start + tile_size) - F.greatest(
        F.col("start"), tile_start
    )
    return (
        placed.withColumn("tile", F.explode(F.sequence(F.lit(1), F.lit(tiles))))
        .withColumn("rows", overlap)
        .filter("rows > 0")
        .groupBy(*groups, "tile")
        .agg(
            F.sum("rows").alias("n"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            F.sum(F.col("value") * F.col("rows").cast("decimal(12,0)")).alias("sum_value"),
        )
    )
