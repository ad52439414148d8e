"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges(a, b)`; root is the smallest node reachable.

    `edges` holds integers; direction, repeats and loops don't matter. Nodes that have no
    edge to another node get no row. Each step groups with partial aggregation and joins
    the minimum back, so a hub's edges never have to meet in one task; the edge list is
    checkpointed after each step, so that no plan holds a step several times, and nothing
    but two numbers reaches the driver.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct())
    before = None
    while True:
        print_ = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if print_ == before or not print_[0]:
            return staged(edges.select(F.col("v").alias("node"), F.col("m").alias("root")).union(edges.select("m", "m")).distinct())  # each later plan would hold it as often as it is used
        before = print_
        both = edges.union(edges.select("m", "v"))
        low = both.groupBy(F.col("v").alias("u")).agg(F.least(F.min("m"), F.col("u")).alias("low"))
        large = both.where("m > v").join(low, F.col("v") == F.col("u")).select(F.col("m").alias("v"), F.col("low").alias("m")).where("v <> m")
        large = staged(large.union(low.where("low < u").select("u", "low")).distinct())
        low = large.groupBy(F.col("v").alias("u")).agg(F.min("m").alias("low"))
        small = large.join(low, F.col("v") == F.col("u")).where("m > low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        edges = staged(small.union(low.select("u", "low")).distinct())
