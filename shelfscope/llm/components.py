"""Connected components of a table of links, by alternating large and small stars.

Every round is a grouped minimum and an equi-join; no component is ever
gathered in one place.  Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.base import written
from shelfscope.session import intermediates


def _settled(links: DataFrame) -> bool:
    """Whether every node is tied to one root only and no root is tied to another: one row to the driver."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    loose = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1")
    return loose.isEmpty()


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node of links (a, b); rows with a null or a = b are passed over."""
    with intermediates(links.sparkSession):
        links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
        while not _settled(links):
            # Large star: the larger neighbours of a node are tied to its smallest neighbour.
            edges = _both_ways(links)
            # Minima are written before they meet the links: both sides of the
            # join are then plain shuffles, and a hub's links can be split.
            smallest = written(edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
            large = written(edges.filter("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
            # Small star: the smaller neighbours of a node, and itself, are tied to the smallest of them.
            lowest = written(large.groupBy("a").agg(F.min("b").alias("m")))
            small = (
                large.join(lowest, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .union(lowest.select("a", F.col("m").alias("b")))
                .distinct()
            )
            links = written(small)
        links = written(links, outlives=True)
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
