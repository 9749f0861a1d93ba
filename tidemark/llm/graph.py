"""Connected components of a graph of links, by alternating large-star and small-star steps.

(Kiveris et al., Connected Components in MapReduce and Beyond, 2014.) Every step is a
partial aggregate (least neighbour) and an equi-join; a hot node is one key of a join that
AQE splits, and links are de-duplicated before each shuffle. Steps are written to the
shared folder, so a lost executor costs one step at most; nothing is collected but two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link between two nodes; component: its least node."""
    now = settle(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        # large star: every larger neighbour points to the node's least neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every smaller neighbour, and the node, point to the least
        large = settle(large.filter("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = settle(small.filter("u <> v").distinct(), "small-star")
        sums = now.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
