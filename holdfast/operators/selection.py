"""Exact values at wanted ranks, by splitters taken from the data.

Where a group has at most ``MOST_VALUES`` different values, counts per value - combined before the
shuffle - and a running sum over them give the value at any rank. A group with more is split first: an
approximate quantile sketch gives splitters, one pass counts the rows between them, and only the buckets
that hold a wanted rank are read again, and split again while they have too many values. So the last
step sees a bounded number of values, however these lie and however often one of them repeats,
and rows outside the wanted buckets are counted but never shuffled.

The rows are read twice, and twice more for every split: pass a written table.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.operators.joins import join_own_aggregate
from holdfast.session import stage

SPLITTERS = 64
EVEN = 8
MOST_VALUES = 1_000_000


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of the one row of ``right`` that has their keys; without keys, of its only row."""
    if keys:
        return join_own_aggregate(left, right, keys)
    one = left.withColumn("one", right.select(F.struct(*right.columns)).scalar())
    return one.select(*left.columns, *[F.col("one")[c].alias(c) for c in right.columns])


def _placed(rows: DataFrame, keys: list[str], level: int, splitters: int) -> DataFrame:
    """Rows with the number of their bucket: one for each cut, and one for each gap between cuts.

    A value that is a cut has a bucket of its own, however often it occurs. The range is cut evenly as
    well, so that every gap is narrower than its bucket was, whatever the sketch says.
    """
    kind = rows.schema["value"].dataType
    shares = F.array(*[F.lit(i / splitters) for i in range(1, splitters)])
    width = (F.col("high") - F.col("low")).cast(kind)
    even = [(F.col("low") + width / EVEN * i).cast(kind) for i in range(1, EVEN)]
    found = rows.groupBy(*keys).agg(
        F.percentile_approx("value", shares).alias("cuts"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    cuts = F.array_union("cuts", F.array("low", *even, "high"))
    cuts = stage(found.filter("low IS NOT NULL").select(*keys, cuts.alias("cuts")), "splitters")
    value = F.col("value")
    bucket = F.size(F.filter("cuts", lambda cut: cut < value)) + F.size(F.filter("cuts", lambda cut: cut <= value))
    return _meet(rows, cuts, keys).select(*keys, "value", bucket.alias(f"bucket_{level}"))


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.approx_count_distinct("value").alias("n_values"))


def _wanted(counts: DataFrame) -> tuple[DataFrame, int]:
    """Groups with the ranks that lie in them, and the most different values that one of these has.

    ``before`` rows of the original group precede it, ``n`` rows are in it.
    """
    held = F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    wanted = stage(counts.withColumn("ranks", held).filter(F.size("ranks") > 0).drop("n"), "wanted")
    return wanted.drop("n_values"), wanted.agg(F.max("n_values")).first()[0] or 0


def values_at_ranks(
    df: DataFrame,
    groups: list[str],
    value: str,
    ranks: Column,
    splitters: int = SPLITTERS,
    most_values: int = MOST_VALUES,
) -> DataFrame:
    """Value at each 0-based rank. Columns: the groups, ``total``, ``rank``, ``at_rank``.

    ``ranks`` is an array expression over ``total``, the number of rows of the group, and the groups.
    Null values are left out; a group without others gives no row, nor does a rank beyond the total.
    """
    rows = df.select(*groups, F.col(value).alias("value")).filter("value IS NOT NULL")
    keys = list(groups)
    counts = _counted(rows, keys).withColumn("total", F.col("n"))
    counts = counts.withColumns({"ranks": F.array_distinct(ranks), "before": F.lit(0).cast("bigint")})
    wanted, most = _wanted(counts)
    level = 0
    while most > most_values:
        placed = _placed(rows, keys, level, splitters)
        bucket = f"bucket_{level}"
        # A group has at most twice as many buckets as splitters.
        walk = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        counts = _counted(placed, [*keys, bucket]).withColumn("earlier", F.coalesce(F.sum("n").over(walk), F.lit(0)))
        counts = _meet(counts, wanted, keys).withColumn("before", F.col("before") + F.col("earlier")).drop("earlier")
        wanted, most = _wanted(counts)
        keys = [*keys, bucket]
        rows = join_own_aggregate(placed, wanted.select(*keys), keys)
        level += 1

    values = rows.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    walk = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n").over(walk), F.lit(0))
    met = _meet(values, wanted, keys).withColumn("start", start)
    here = F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))
    return met.withColumn("rank", F.explode(here)).select(*groups, "total", "rank", F.col("value").alias("at_rank"))


def position(p: str, total: Column | None = None) -> Column:
    """Place of a quantile among ``total`` sorted values, from 0; ``p`` is decimal text."""
    total = F.col("total") if total is None else total
    return (total - 1).cast("decimal(18,0)") * F.lit(Decimal(p)).cast("decimal(5,4)")


def around(p: str, total: Column | None = None) -> list[Column]:
    """The two ranks between which a quantile lies."""
    at = position(p, total)
    return [F.floor(at).cast("bigint"), F.ceil(at).cast("bigint")]


def interpolated(found: DataFrame, groups: list[str], probs: list[str]) -> DataFrame:
    """The groups and ``quantiles``, a map from each probability as given to a ``decimal(24,4)``."""
    # At most two entries per probability reach the map of a group.
    held = found.groupBy(*groups).agg(
        F.max("total").alias("total"), F.map_from_entries(F.collect_set(F.struct("rank", "at_rank"))).alias("at")
    )

    def quantile(p: str) -> Column:
        low, high = (F.element_at("at", r).cast("decimal(20,4)") for r in around(p))
        part = (position(p) - around(p)[0]).cast("decimal(5,4)")
        return (low + (high - low) * part).cast("decimal(24,4)")

    pairs = [x for p in probs for x in (F.lit(p), quantile(p))]
    return held.filter("total IS NOT NULL").select(*groups, F.create_map(*pairs).alias("quantiles"))


def quantiles(
    df: DataFrame,
    groups: list[str],
    value: str,
    probs: list[str],
    splitters: int = SPLITTERS,
    most_values: int = MOST_VALUES,
) -> DataFrame:
    """Linearly interpolated quantiles of a column: the groups and ``quantiles`` as in ``interpolated``."""
    ranks = F.array(*[r for p in probs for r in around(p)])
    return interpolated(values_at_ranks(df, groups, value, ranks, splitters, most_values), groups, probs)
