"""Connected components by alternating large and small stars, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored


def _to_smallest(neighbours: DataFrame, keep) -> DataFrame:
    """Link what a node is linked with to the smallest node among it and the node."""
    # Stored, so that the join can split the rows of a node with very many links.
    least = stored(neighbours.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return neighbours.join(least, "u").filter(keep)


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: every node of ``edges (u, v)`` and the smallest it reaches.

    Each round hangs nodes on smaller ones, by joins that adaptive execution splits
    where a node has very many links, and writes the links in the shared folder. The
    rounds grow with the logarithm of the number of nodes.
    """
    def tidy(links: DataFrame) -> DataFrame:
        """u > v, each link once."""
        return (
            links.filter("u != v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )

    def state(links: DataFrame):
        return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    links = stored(tidy(edges))
    before = state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both, F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        large = stored(tidy(large))
        small = _to_smallest(large, F.lit(True))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        links = stored(tidy(small))
        after = state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
