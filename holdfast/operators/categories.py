"""Category values as an index table, and the stage that joins it to rows.

The index has one row per column and distinct value, with the value's position in ascending order.
Positions come from ranges: the distinct values are dealt into ordered blocks, each block is numbered
on its own, and the totals of the blocks before it - one row per block - are added. Nothing is
collected and no task sees more than a block, so the number of values has no limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Transformer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.session import stage

INDEX = "name string, value string, position bigint"


def category_index(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, value, position (from 0, in ascending order) of the values of text columns; nulls have none."""
    if not columns:
        return df.sparkSession.createDataFrame([], INDEX)
    cells = [F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    values = df.select(F.inline(F.array(*cells))).filter("value IS NOT NULL").distinct()
    # Written with their block, so that the borders cannot move between the two readings.
    ranged = stage(
        values.repartitionByRange("name", "value").withColumn("block", F.spark_partition_id()), "category_values"
    )
    earlier = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("name", "block")
        .agg(F.count("*").alias("n"))
        .select("name", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    inside = F.row_number().over(Window.partitionBy("name", "block").orderBy("value"))
    numbered = ranged.withColumn("inside", inside).join(totals, ["name", "block"])
    return stage(
        numbered.select("name", "value", (F.col("before") + F.col("inside") - 1).alias("position")), "category_index"
    )


def category_sizes(index: DataFrame, columns: list[str]) -> dict[str, int]:
    """Number of values of each column."""
    found = {r["name"]: r["n"] for r in index.groupBy("name").agg(F.count("*").alias("n")).collect()}
    return {c: found.get(c, 0) for c in columns}


def with_positions(df: DataFrame, index: DataFrame, columns: list[str], suffix: str = "_position") -> DataFrame:
    """The position of every column's value; null for null and for values that the index does not hold.

    One left join per column against one row per value: rows neither multiply nor vanish. A small
    index is broadcast by its size, a large one is joined by a shuffle that Spark splits where skewed.
    """

    def join_one(rows: DataFrame, name: str) -> DataFrame:
        value, position = f"{name}{suffix}_value", f"{name}{suffix}"
        own = index.filter(F.col("name") == name).select(
            F.col("value").alias(value), F.col("position").alias(position)
        )
        return rows.join(own, F.col(f"`{name}`").cast("string") == F.col(f"`{value}`"), "left").drop(value)

    return reduce(join_one, columns, df)


def strict_index(name: str, position: str) -> Column:
    """Position of a value; null counts as the first one, an unseen value is an error."""
    value = F.col(f"`{name}`")
    unseen = F.raise_error(F.concat(F.lit(f"unseen {name}: "), value.cast("string"))).cast("int")
    return (
        F.when(value.isNull(), F.lit(0))
        .when(F.col(f"`{position}`").isNull(), unseen)
        .otherwise(F.col(f"`{position}`").cast("int"))
    )


class CategoryEncoder(Transformer, MLWritable, MLReadable):
    """Adds ``<column>_code``: position - 1, or the number of places for the first, null and unseen values.

    A one-hot encoder that drops the last place then has a place per value but the first. The
    column carries its number of values, so that the encoder's size is known without reading rows.
    """

    def __init__(self, index: DataFrame, sizes: dict[str, int]):
        super().__init__()
        self.index, self.sizes = index, sizes

    def code_names(self) -> list[str]:
        return [f"{c}_code" for c in self.sizes]

    def coded(self, name: str, position: str) -> Column:
        """Code of one column from its position."""
        places = self.sizes[name] - 1
        at = F.col(f"`{position}`")
        code = F.when(at >= 1, at - 1).otherwise(F.lit(places)).cast("double")
        return code.alias(f"{name}_code", metadata={"ml_attr": {"type": "nominal", "num_vals": places + 1}})

    def empty(self) -> DataFrame:
        """No rows, with the code columns as ``transform`` makes them."""
        none = self.index.sparkSession.createDataFrame([], ", ".join(f"`{c}` bigint" for c in self.sizes))
        return none.select(*[self.coded(c, c) for c in self.sizes])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = list(self.sizes)
        joined = with_positions(dataset, self.index, names, "_code_at")
        codes = [self.coded(c, f"{c}_code_at") for c in names]
        return joined.select(*[F.col(f"`{c}`") for c in dataset.columns], *codes)

    def write(self) -> MLWriter:
        return _EncoderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EncoderReader()


class _EncoderWriter(MLWriter):
    def __init__(self, encoder: CategoryEncoder):
        super().__init__()
        self.encoder = encoder

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.encoder, path, self.sparkSession, {"sizes": self.encoder.sizes})
        self.encoder.index.write.parquet(f"{path}/index")


class _EncoderReader(MLReader):
    def load(self, path: str) -> CategoryEncoder:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        encoder = CategoryEncoder(self.sparkSession.read.schema(INDEX).parquet(f"{path}/index"), metadata["sizes"])
        encoder._resetUid(metadata["uid"])
        return encoder
