"""Connected components of a link table, by stars; links and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.storage import stored


def _nearest(links: DataFrame) -> DataFrame:
    """For each node the smaller of itself and its smallest neighbour (combined before the shuffle).

    Stored, so that the join with it reads both sides from a shuffle and can be split.
    """
    return stored(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))


def _fingerprint(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of nodes to (node, component): the smallest node reachable.

    Each round hangs every node's larger neighbours, and then its smaller ones, on the smallest of
    them; the number of rounds grows with the logarithm of the longest path. A node with many
    neighbours costs a partial minimum and a join that can be split. Nodes without links to others
    are not returned. Nulls link nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = stored(edges)
    before = None
    while (now := _fingerprint(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_nearest(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stored(large.where("a != b").distinct())
        small = large.join(_nearest(large), "a")
        small = small.select("b", "low").union(small.select("a", "low")).toDF("a", "b")
        edges = stored(small.where("a != b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
