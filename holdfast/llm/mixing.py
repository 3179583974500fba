"""Mixing sources to target weights by systematic sampling.

Every source gets a target in words: its share of the wanted total by weight, at most ``stop``
times its own size, what is cut off going to the others by weight until none is above (the
level of that filling is found in closed form). A document's expected copies are its source's
target over its source's size. They are summed along the source in an order that puts
documents of about the same size together, one random offset per source is added, and a
document is taken once per integer that its stretch of the sum crosses. Sums are integers in
units of 2**-24 copies, so no rounding depends on partitioning and nothing exceeds ``stop``.

The running sum of a source is never made in one task: rows are summed within blocks (source,
size class, leading hash digits), blocks of a source are summed in a window over block totals.

Null text has size 0 and is treated as any document; a null source is a source of its own, the
last one. Rows with one doc_id are separate documents. A source without words has target 0 and
is not taken. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import own_columns, shielded, stage

ONE = 1 << 24
SEED = "mixture"
WEIGHTS = (3, 1, 2)
BLOCK_ROWS = 1_000_000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, share: float, stop: float, weights: tuple[int, ...]) -> DataFrame:
    """``sizes`` has a row per source (source_key, source, source_size); adds target."""
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_code_point) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("double")).withColumn(
        "cap", F.lit(float(stop)) * F.col("source_size")
    )
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (
        F.lit(float(share)) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    capped = F.col("cap") <= F.col("level") * F.col("weight")
    return (
        ranked.withColumn("level", level)
        .withColumn("capped", capped)
        .withColumn("water", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("capped"), F.col("cap")).otherwise(F.col("water") * F.col("weight")),
        )
        .select("source_key", "source_size", "target")
    )


def mixture(
    docs: DataFrame,
    share: float = 1.5,
    stop: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: doc_id, source_key, size, source_size, target, copies.

    The same rows and seed always give the same copies.
    """
    source_key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = own_columns(docs, "doc_id", "source", "text").select(
        "doc_id", "source", source_key.alias("source_key"), word_count(F.col("text")).alias("size")
    )
    rows = stage(sized, "sizes")

    sizes = rows.groupBy("source_key").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n")
    )
    n_rows = rows.count()
    digits = max(1, math.ceil(math.log(max(1, n_rows / BLOCK_ROWS), 16)))
    targets = stage(source_targets(sizes, share, stop, weights), "targets")
    step = F.coalesce(
        F.floor(F.col("target") / F.col("source_size") * ONE + 0.5), F.lit(0)
    ).cast("bigint")
    bits = F.bin(F.col("size"))
    size_class = F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 2, 3))
    order = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = rows.join(targets, "source_key").select(
        "doc_id", "source_key", "size", "source_size", "target", step.alias("step"),
        size_class.alias("size_class"), order.alias("order"),
        F.substring(order, 1, digits).alias("lead"),
    )
    block = ["source_key", "size_class", "lead"]
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "#"), F.col("source_key"))), 1, 6), 16, 10)
    along = Window.partitionBy("source_key").orderBy("size_class", "lead")
    blocks = stage(
        placed.groupBy(*block).agg(F.sum("step").alias("steps")).select(
            *block,
            (
                F.coalesce(F.sum("steps").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                + offset.cast("bigint")
            ).alias("base"),
        ),
        "blocks",
    )
    within = (
        Window.partitionBy(*block)
        .orderBy("order", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upto = F.sum("step").over(within)
    summed = placed.withColumn("upto", upto).join(blocks, block)
    end = F.col("base") + F.col("upto")
    copies = F.shiftright(end, 24) - F.shiftright(end - F.col("step"), 24)
    return summed.select(
        "doc_id", "source_key", "size", "source_size", "target", copies.cast("int").alias("copies")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mixture, each as often as it was taken, all columns kept."""
    docs, back = shielded(docs, "doc_id", "text", "source")
    plan = stage(mixture(docs, **options), "mixture")
    key = lambda doc_id, size, source: F.sha1(
        F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string"), source)
    )
    wanted = plan.groupBy(key(F.col("doc_id"), F.col("size"), F.col("source_key")).alias("_key")).agg(
        F.count("*").alias("_rows"), F.sum("copies").alias("_copies")
    )
    wanted = stage(wanted.filter("_copies > 0"), "wanted")
    source_key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    marked = docs.withColumn("_key", key(F.col("doc_id"), word_count(F.col("text")), source_key))
    joined = marked.join(wanted, "_key")
    # Rows that share id, size and source divide their copies between them.
    at = F.row_number().over(Window.partitionBy("_key").orderBy("_key")) - 1
    share = F.floor(F.col("_copies") / F.col("_rows")) + F.when(
        at < F.col("_copies") % F.col("_rows"), 1
    ).otherwise(0)
    times = joined.withColumn("_times", share.cast("int")).filter("_times > 0")
    return back(times.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_times")))))
