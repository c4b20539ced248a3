"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a shuffle with partial aggregation; nothing is gathered on the driver but the
number of links that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b of one type), where component is
    the smallest node of its component.  Self-links only make their node known."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    first = edges
    while True:
        # large star: each node links its larger neighbours, and itself, to its smallest neighbour
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.where("m < a").select("a", F.col("m").alias("b"))
        # small star: each node links its smaller neighbours, and itself, to the smallest of them
        up = stored(large.union(own).distinct())
        least = up.groupBy("a").agg(F.min("b").alias("m"))
        small = up.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stored(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        release(up)
        # stars all: no node is both above and below, or below twice
        ends = new.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(new.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        done = ends.where("up + down > 1").isEmpty()
        if edges is not first:
            release(edges)
        edges = new
        if done:
            break
    nodes = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    found = nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("m")), "node", "left")
    out = stored(found.select("node", F.coalesce("m", "node").alias("component")))
    release(first)
    if edges is not first:
        release(edges)
    return out
