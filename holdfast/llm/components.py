"""Connected components by alternating large and small stars.

Each round is two aggregates and two joins over edges; every table of a round is written to the
shared folder, so lineage stays short and a hot vertex meets its neighbours in a join that Spark can
split. Only the aggregates are shuffled: a round never makes more edges than it reads, so that
repeated ones may stay until an aggregate folds them. The number of rounds grows with the logarithm
of the longest chain; a round that leaves every node one edge, to a node without one, is the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import stage


def stars(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for the nodes of edges that are not the smallest of their component; ids are numbers."""
    e = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).filter("x <> y")
    e = stage(e, "edges")
    while True:
        both = e.select(F.col("x").alias("u"), F.col("y").alias("v")).union(e.select("y", "x"))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))
        large = stage(large, "large")
        smallest = stage(large.groupBy("x").agg(F.min("y").alias("m")), "smallest")
        moved = large.join(smallest, "x").filter("y > m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        moved = stage(moved, "moved")
        done = smallest.select(F.col("x").alias("node"), F.col("m").alias("component"))
        if moved.isEmpty() and smallest.join(done, F.col("m") == F.col("node"), "left_semi").isEmpty():
            return done
        e = moved.union(smallest.select("x", F.col("m").alias("y")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of an edge; ids are numbers."""
    found = stars(edges, a, b)
    hubs = found.select(F.col("component").alias("node"), "component").distinct()
    return found.union(hubs)
