"""How later rows differ from reference rows: score distribution, column distribution, rates.

The reference is kept as a histogram: one row per column and bin with its number of rows. Histograms of
parts add up, so that of a long period is the sum of those of its days, and later rows are compared without
reading the reference again. Rows without a value have a bin of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.operators.selection import values_at_ranks

SCORE_BINS = 1000
LEAST_SHARE = 1e-4
HISTOGRAM = "column_name string, bin string, n bigint"


def rank_edges(df: DataFrame, columns: list[str], parts: int = 10) -> dict[str, list]:
    """Distinct values at the ranks that cut each numeric column into equal parts; ``parts`` at most."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("decimal(28,6)").alias("value")) for c in columns]
    ranks = F.array(*[F.floor((F.col("total") - 1) * k / parts).cast("bigint") for k in range(parts)])
    found = values_at_ranks(df.select(F.inline(F.array(*cells))), ["column_name"], "value", ranks)
    edges: dict[str, set] = {c: set() for c in columns}
    for r in found.collect():
        edges[r["column_name"]].add(r["at_rank"])
    return {c: sorted(values) for c, values in edges.items()}


def histogram(df: DataFrame, texts: list[str], edges: dict[str, list]) -> DataFrame:
    """column_name, bin, n: a bin per value of a text column, or between the edges of a numeric one."""

    def between(name: str, cuts: list) -> Column:
        value = F.col(name).cast("decimal(28,6)")
        place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= value)) if cuts else F.lit(0)
        return F.when(value.isNotNull(), place).cast("string")

    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("bin")) for c in texts]
    cells += [F.struct(F.lit(c).alias("column_name"), between(c, cuts).alias("bin")) for c, cuts in edges.items()]
    return df.select(F.inline(F.array(*cells))).groupBy("column_name", "bin").agg(F.count("*").alias("n"))


def merged(*histograms: DataFrame) -> DataFrame:
    """The histogram of all rows of several ones."""
    every = histograms[0]
    for more in histograms[1:]:
        every = every.unionByName(more)
    return every.groupBy("column_name", "bin").agg(F.sum("n").alias("n"))


def stability_index(reference: DataFrame, later: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """column_name, n_bins, psi: sum over the bins of (p - q) ln(p / q), shares counting as ``least`` at least."""
    sides = reference.withColumn("side", F.lit(0)).unionByName(later.withColumn("side", F.lit(1)))
    n = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    bins = sides.groupBy("column_name", "bin").agg(n(0).alias("n0"), n(1).alias("n1"))
    totals = bins.groupBy("column_name").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    share = lambda k: F.greatest(F.col(f"n{k}") / F.col(f"t{k}"), F.lit(least))
    p, q = share(0), share(1)
    return (
        bins.join(totals, "column_name")
        .groupBy("column_name")
        .agg(F.count("*").alias("n_bins"), F.sum((p - q) * F.ln(p / q)).alias("psi"))
    )


def score_histogram(scored: DataFrame, bins: int = SCORE_BINS) -> DataFrame:
    """model_name, bin, n: equal bins of churn_probability on 0..1; rows without a score are left out."""
    place = F.least(F.greatest(F.floor(F.col("churn_probability") * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return (
        scored.filter("churn_probability IS NOT NULL").groupBy("model_name", place.alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def score_distance(reference: DataFrame, later: DataFrame) -> DataFrame:
    """model_name, ks: largest difference of the two cumulative shares over the bins of score histograms."""
    sides = reference.withColumn("side", F.lit(0)).unionByName(later.withColumn("side", F.lit(1)))
    n = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    both = sides.groupBy("model_name", "bin").agg(n(0).alias("n0"), n(1).alias("n1"))
    whole = Window.partitionBy("model_name")  # at most SCORE_BINS rows
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda k: F.sum(f"n{k}").over(upto) / F.sum(f"n{k}").over(whole)
    return both.withColumn("apart", F.abs(share(0) - share(1))).groupBy("model_name").agg(F.max("apart").alias("ks"))


def rate_gap(scored: DataFrame) -> DataFrame:
    """Per model and tier: rows, mean score, observed rate and their difference; ``scored`` has churned_actual."""
    known = scored.filter("churn_probability IS NOT NULL AND churned_actual IS NOT NULL")
    return (
        known.groupBy("model_name", "risk_tier")
        .agg(
            F.count("*").alias("n"), F.avg("churn_probability").alias("mean_score"),
            F.avg(F.col("churned_actual").cast("double")).alias("observed_rate"),
        )
        .withColumn("gap", F.col("mean_score") - F.col("observed_rate"))
    )
