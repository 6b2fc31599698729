"""Connected components of links in Spark, by alternating large and small stars; links never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm._common import staged, unstaged


def _lowest(links: DataFrame) -> DataFrame:
    """(a, low): the smallest of a node and its neighbours; folded before the shuffle."""
    return links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_lowest(both), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    # Every link goes from the larger to the smaller node, and large stars make no others.
    low = _lowest(links)
    moved = links.join(low, "a").where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b")))


def _is_done(links: DataFrame) -> bool:
    """Whether the links are stars: every node that is not a centre has one link, to a centre."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("links"), F.lit(0).alias("centre"))
    ends = ends.unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("links"), F.lit(1).alias("centre")))
    nodes = ends.groupBy("node").agg(F.sum("links").alias("links"), F.max("centre").alias("centre"))
    return nodes.where((F.col("links") > 1) | (F.col("links") == 1) & (F.col("centre") == 1)).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component): of every node in `links` (columns a, b) the smallest node it is connected with.

    Links may repeat, run either way or join a node to itself. Each round is written to the shared folder, so that a lost
    executor costs one round at most. The number of rounds grows with the logarithm of the longest chain.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    links = staged(ordered.distinct(), "components")
    while not _is_done(links):
        last, links = links, staged(_small_star(_large_star(links)).distinct(), "components")
        unstaged(last)
    ends = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(ends)
