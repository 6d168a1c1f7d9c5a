"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

EDGES = 500_000  # of a task


def components(links: DataFrame, scope: str = "query") -> DataFrame:
    """``node, component`` (the smallest node reachable) of all nodes that ``links`` (``a, b`` long) mention.

    A step sends each node's neighbours to its smallest one, so stars stay stars and paths halve; edges never grow in
    number. Minima are pre-aggregated and written before they are joined back: the join then has a plain scan on that side,
    so that Spark can broadcast it where it is small and split a node with very many neighbours where it isn't. The work
    is done once every node but the smallest of its neighbourhood has one neighbour alone.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges", scope)
    parts = max(8, -(-edges.count() // EDGES))  # later tables have no more rows

    def write(df: DataFrame, name: str, scope: str) -> DataFrame:
        return staged(df.coalesce(parts), name, scope)

    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write(both.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n")).select("u", F.least("u", "v").alias("m"), "n"), "least", scope)
        if least.filter("m < u and n > 1").isEmpty():
            break
        large = both.join(least.select("u", "m"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = write(large.groupBy("u").agg(F.min("v").alias("m")), "least", scope)  # a hub may be larger than its neighbours, too
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = write(small.filter("u <> v").distinct(), "edges", scope)
    return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
