"""Connected components of a table of links, by alternating large and small stars.

Each round joins nodes to the least neighbour they know, so paths shorten to stars
in a number of rounds that grows with the logarithm of the longest one. Rounds are
written tables; nothing but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pinwright.llm.frames import join_hot
from pinwright.sources.shared import staged


def _least(edges: DataFrame) -> DataFrame:
    return staged(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "star-least")


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node that has a link to another, and its component's least node."""
    edges = staged(links.where(F.col(a) != F.col(b))
                   .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).withColumn("m", F.least("u", "m"))
        large = staged(join_hot(both, least, ["u"]).where("v > u")
                       .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = _least(large)
        small = join_hot(large, least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
