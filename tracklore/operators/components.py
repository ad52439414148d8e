"""Splits that no source crosses: clips that share a source, directly or over others, stay together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dataset
from .staging import kept


def clip_components(rows: DataFrame, clip: str, path: str) -> DataFrame:
    """(clip, component) for each clip of `rows(clip, path)`: the smallest clip that can be reached over shared paths.

    The graph is contracted: each clip points to the smallest clip it shares a path with, its
    own included, pointers are followed to their end by doubling, so that a long chain
    takes few steps, and the links between those ends are the next, smaller graph, until no
    link is left. A path links each of its clips with its smallest one only, so a path
    that any number of clips have gives as many links. Clips without a path (null) are
    alone; null clips don't count; repeated rows count once.
    """
    pairs = rows.select(F.col(clip).alias("clip"), F.col(path).alias("path")).where("clip IS NOT NULL").distinct()
    least = pairs.where("path IS NOT NULL").groupBy("path").agg(F.min("clip").alias("least"))
    links = kept(pairs.join(least, "path").where("clip <> least").select(F.col("clip").alias("a"), F.col("least").alias("b")).distinct())
    found = kept(pairs.select("clip").distinct().withColumn("component", F.col("clip")))
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        taken = ends_of(kept(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))))
        named = found.join(taken, found.component == taken.a, "left")
        found = kept(named.select("clip", F.coalesce("to", "component").alias("component")))
        moved = links.join(taken.select("a", F.col("to").alias("to_a")), "a").join(taken.select(F.col("a").alias("b"), F.col("to").alias("to_b")), "b")
        links = kept(moved.where("to_a <> to_b").select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct())
    return found.select(F.col("clip").alias(clip), "component")


def ends_of(pointers: DataFrame) -> DataFrame:
    """`pointers(a, to)`, where `to` is a node too and never greater, followed to their end: half of what is left with each step."""
    while True:
        further = kept(pointers.join(pointers.select(F.col("a").alias("to"), F.col("to").alias("end")), "to").select("a", "to", "end"))
        moved = not further.where("end <> to").isEmpty()
        pointers = further.select("a", F.col("end").alias("to"))
        if not moved:
            return pointers


def component_split(rows: DataFrame, clip: str, path: str, fraction: float, seed: str) -> DataFrame:
    """(clip, component, split): whole components go to `val` or `train`, by the hash of the component."""
    parts = clip_components(rows, clip, path).withColumn("key__", F.col("component").cast("string"))
    return dataset.hash_split(parts, "key__", fraction, seed).drop("key__")


def crossing_paths(rows: DataFrame, splits: DataFrame, clip: str, path: str) -> DataFrame:
    """(path, n_splits) of the paths that clips of several splits have, from `splits(clip, split)`; none if a split is sound."""
    placed = rows.select(clip, path).where(F.col(path).isNotNull()).join(splits.select(clip, "split"), clip)
    return placed.groupBy(path).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")
