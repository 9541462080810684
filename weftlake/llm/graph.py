"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.session import drop_stash, stash


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node with a link to another; component is its smallest node.

    ``links`` holds two long columns. Each round links every node's larger
    neighbours to its least neighbour (large star) and then its smaller ones
    (small star), until a round changes nothing: O(log^2) rounds, with one row a
    link, all in Spark. Hubs are pre-aggregated for their least neighbour, and
    both sides of each join are plain exchanges that AQE can split.
    """
    a, b = F.col(u), F.col(v)
    e = stash(links.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    seen = _mark(e)
    while seen[0]:
        both = e.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(e.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = stash(both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least")), "least")
        large = stash(both.filter("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("least").alias("lo")).distinct(), "large")
        low = stash(large.groupBy("hi").agg(F.min("lo").alias("least")), "low")
        small = (
            large.join(low, "hi").filter("lo != least").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).unionByName(low.select("hi", F.col("least").alias("lo"))).distinct()
        )
        new = stash(small, "links")
        now = _mark(new)
        for x in (e, least, large, low):
            drop_stash(x)
        e = new
        if now == seen:
            break
        seen = now
    star = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return star.unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
