"""[T8, T9] Distance-1 colouring of vertices or hyperedges within parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import NGraph
from ..iterate import stored
from .adjacency import eve, vev


def color(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, color) by Jones-Plassmann: in each round the nodes whose priority, a hash of the
    node, is above their uncoloured neighbours' take the least colour no neighbour has.
    ``links``: (a, b), both ways, without loops."""
    priority = lambda c: F.struct(F.xxhash64(c), F.col(c))
    links = stored(links.select("a", "b").distinct())
    left, done = stored(nodes.select("node")), None
    while True:
        open_ = links.join(left.withColumnRenamed("node", "a"), "a").join(left.withColumnRenamed("node", "b"), "b")
        beaten = open_.where(priority("a") < priority("b")).select(F.col("a").alias("node")).distinct()
        turn = stored(left.join(beaten, "node", "left_anti"))
        if turn.isEmpty():
            return done if done is not None else nodes.select("node", F.lit(None).cast("int").alias("color"))
        if done is None:
            new = turn.select("node", F.lit(0).alias("color"))
        else:
            used = links.join(turn.withColumnRenamed("node", "a"), "a").join(done.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_set("color")).alias("used"))
            # colours are 0, 1, ...: the first place that doesn't hold its own number is free
            free = F.coalesce(F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used")), F.lit(0))
            new = turn.join(used, "node", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>"))).select("node", free.cast("int").alias("color"))
        new = stored(new)
        done = new if done is None else done.unionByName(new)
        left = stored(left.join(new.select("node"), "node", "left_anti"))


def color_vertices(g: NGraph, etype: int = 0) -> DataFrame:
    """(part, gid, color): neighbours in a part differ."""
    own = g.vertices.select("gid", "part")
    pairs = vev(g, etype).withColumnsRenamed({"gid": "a", "nbr": "b"})
    if not g.is_hyper:
        pairs = pairs.union(pairs.select("b", "a"))
    pairs = pairs.join(own.withColumnsRenamed({"gid": "a", "part": "p"}), "a").join(own.withColumnsRenamed({"gid": "b", "part": "q"}), "b").where("p = q")
    return own.join(color(own.select(F.col("gid").alias("node")), pairs).withColumnRenamed("node", "gid"), "gid").select("part", "gid", "color")


def color_edges(g: NGraph, etype: int = 0) -> DataFrame:
    """(part, eid, color): a part's edge copies that share a vertex it owns differ."""
    name = lambda e: F.struct("part", F.col(e).alias("eid"))
    pairs = eve(g, etype).select(name("eid").alias("a"), name("nbr").alias("b"))
    nodes = g.resident(etype).select(name("eid").alias("node"))
    return color(nodes, pairs).select("node.part", "node.eid", "color")


def vertex_conflicts(g: NGraph, colors: DataFrame, etype: int = 0) -> DataFrame:
    """Pairs of neighbours in a part with one colour; none if the colouring is proper."""
    a, b = colors.select("part", "gid", "color"), colors.select("part", F.col("gid").alias("nbr"), "color")
    return vev(g, etype).join(a, "gid").join(b, ["part", "nbr", "color"]).select("part", "gid", "nbr", "color")


def edge_conflicts(g: NGraph, colors: DataFrame, etype: int = 0) -> DataFrame:
    """Vertices with two edges of one colour; none if the colouring is proper."""
    return g.pin_owner(etype).join(colors, ["part", "eid"]).groupBy("part", "gid", "color").agg(F.count("*").alias("n")).where("n > 1")
