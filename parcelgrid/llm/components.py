"""Connected components as Spark jobs: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.sources.tables import materialise


#: Links in a file of a step, so that a small step is not written as hundreds of files.
FILE_ROWS = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the least of its neighbours and itself."""
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").where("b <> least").select("b", "least")
    return moved.union(least.select("a", "least")).toDF("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node of its component.

    Takes the number of rounds a path's length needs, which grows with its logarithm. Each step
    is an aggregation and an equi-join, so a node with most of the links is combined before the
    shuffle and split in the join. Every step is written, so a lost executor costs one step.
    No links give no rows; links with a null end and links of a node to itself are left out.
    """
    a, b = edges.columns
    now = materialise(
        edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    seen = None
    while True:
        mark = now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select("b", "b").distinct()
            )
        seen = mark
        files = 1 + mark[0] // FILE_ROWS
        large = materialise(_large_star(now).coalesce(files))
        now = materialise(_small_star(large).coalesce(files))
