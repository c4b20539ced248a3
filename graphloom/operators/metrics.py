"""Counts, weights, imbalance, sides and the evaluation of a partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import NGraph, source_target
from .traverse import count_disconnected


def over_parts(g: NGraph, rows: DataFrame, *values: str) -> DataFrame:
    """``rows`` (part, values) with every part, 0 where there was none."""
    return g.parts().join(rows, "part", "left").select("part", *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def counts_per_part(g: NGraph) -> DataFrame:
    """[A1, K5] (part, kind, etype, n): vertices, ghosts, edges and pins that each part holds."""
    own = g.vertices.groupBy("part").agg(F.count("*").alias("n"))
    ghosts = g.ghosts().groupBy("part").agg(F.count("*").alias("n"))
    copies = g.edge_copy().groupBy("part", "etype").agg(F.count("*").alias("edges"), F.sum("deg").alias("pins"))
    out = [over_parts(g, rows, "n").select("part", F.lit(kind).alias("kind"), F.lit(-1).alias("etype"), F.col("n").cast("long")) for kind, rows in (("vertices", own), ("ghosts", ghosts))]
    out += [copies.select("part", F.lit(kind).alias("kind"), "etype", F.col(kind).cast("long").alias("n")) for kind in ("edges", "pins")]
    return reduce(DataFrame.unionByName, out)


def global_counts(g: NGraph) -> DataFrame:
    """[A2] (etype, n_edges, n_pins): each edge once, however many parts hold a copy."""
    edges = g.edges.groupBy("etype").agg(F.count("*").alias("n_edges"))
    if not g.is_hyper:
        return edges.select("etype", "n_edges", (2 * F.col("n_edges")).alias("n_pins"))
    pins = g.pins.groupBy("etype").agg(F.count("*").alias("n_pins"))
    return edges.join(pins, "etype", "left").select("etype", "n_edges", F.coalesce("n_pins", F.lit(0)).cast("long").alias("n_pins"))


def profile(g: NGraph, etype: int = 0) -> DataFrame:
    """(res, w): the weight of the hyperedges that the same parts hold, a row for each such set of parts.
    An edge without pins is at home.  Sides, totals and weights of copies all follow from it."""
    edges = g.typed(g.edges, etype).select("eid", "w", "home_part").join(g.residence(etype).select("eid", "res"), "eid", "left")
    return edges.groupBy(F.coalesce("res", F.array("home_part")).alias("res")).agg(F.sum("w").alias("w"))


def weights(g: NGraph, dim: int, ghosts: bool = False, held: DataFrame | None = None) -> DataFrame:
    """[A6] (part, w): the weight of a part's vertices (dim -1; with its ghosts if asked) or
    edge copies of a type; copies count on every part.  ``held``: the type's profile, if it is known."""
    if dim >= 0 and g.is_hyper:
        held = profile(g, dim) if held is None else held
        rows = held.select(F.explode("res").alias("part"), "w").groupBy("part").agg(F.sum("w").alias("w"))
    elif dim >= 0:
        rows = g.edge_copy(dim).groupBy("part").agg(F.sum("w").alias("w"))
    else:
        own = g.vertices.select("part", "w")
        if ghosts:
            own = own.unionByName(g.ghosts().join(g.vertices.select("gid", "w"), "gid").select("part", "w"))
        rows = own.groupBy("part").agg(F.sum("w").alias("w"))
    return over_parts(g, rows, "w").select("part", F.col("w").cast("double").alias("w"))


def imbalance_of(rows: DataFrame, parts: int) -> DataFrame:
    """[A7] (imb): the largest weight over the mean of all parts, empty ones too; 1 if all is 0."""
    total = F.sum("w")
    return rows.agg(F.when(total == 0, F.lit(1.0)).otherwise(F.max("w") / (total / parts)).alias("imb"))


def imbalances(g: NGraph) -> DataFrame:
    """[A8] (dim, imb) for the vertices, -1, and every edge type."""
    out = [imbalance_of(weights(g, d), g.num_parts).select(F.lit(d).alias("dim"), "imb") for d in range(-1, g.num_types)]
    return reduce(DataFrame.unionByName, out)


def spread(rows: DataFrame, value: str = "w") -> DataFrame:
    """[A9, A11] (max, min, avg, imb) of a value over all parts."""
    v = F.col(value).cast("double")
    return rows.agg(F.max(v).alias("max"), F.min(v).alias("min"), F.avg(v).alias("avg"), (F.max(v) / F.avg(v)).alias("imb"))


def sides(g: NGraph, etype: int = 0, held: DataFrame | None = None) -> DataFrame:
    """[A10] (part, nbr, side): the weight of a part's edge copies that the neighbour holds too.
    Edges with a direction: at the source's part, for the target's."""
    if not g.is_hyper:
        w = g.typed(g.edges, etype).select("eid", "w")
        ends = source_target(g, etype)
        own = g.vertices.select("gid", "part")
        pairs = ends.join(own.withColumnsRenamed({"gid": "u", "part": "p"}), "u").join(own.withColumnsRenamed({"gid": "v", "part": "q"}), "v").where("p <> q")
        return pairs.join(w, "eid").groupBy(F.col("p").alias("part"), F.col("q").alias("nbr")).agg(F.sum("w").alias("side"))
    res = (profile(g, etype) if held is None else held).where(F.size("res") > 1)
    pairs = res.select("w", "res", F.explode("res").alias("part")).select("w", "part", F.explode("res").alias("nbr")).where("part <> nbr")
    return pairs.groupBy("part", "nbr").agg(F.sum("w").alias("side"))


def sides_total(g: NGraph, etype: int = 0, held: DataFrame | None = None) -> DataFrame:
    """[A10] (part, total): the weight of a part's cut copies, each once whatever its neighbours."""
    if not g.is_hyper:
        rows = sides(g, etype).groupBy("part").agg(F.sum("side").alias("total"))
    else:
        res = (profile(g, etype) if held is None else held).where(F.size("res") > 1)
        rows = res.select("w", F.explode("res").alias("part")).groupBy("part").agg(F.sum("w").alias("total"))
    return over_parts(g, rows, "total").select("part", F.col("total").cast("double").alias("total"))


def neighbors(g: NGraph, etype: int = 0) -> DataFrame:
    """(part, n_neighbors), every part."""
    return over_parts(g, sides(g, etype).groupBy("part").agg(F.count("*").alias("n_neighbors")), "n_neighbors")


def neighbor_weights(g: NGraph, dim: int = -1, etype: int = 0) -> DataFrame:
    """[J11] (part, nbr, w): the weight of every neighbouring part."""
    # one row a part
    w = F.broadcast(weights(g, dim).withColumnRenamed("part", "nbr"))
    return sides(g, etype).select("part", "nbr").join(w, "nbr").select("part", "nbr", "w")


def empty_parts(g: NGraph) -> DataFrame:
    """(part): parts without weight, ghosts included."""
    return weights(g, -1, ghosts=True).where("w = 0").select("part")


def edge_cut(g: NGraph) -> DataFrame:
    """(etype, n_cut, w_cut, max_residence): cut edges, each once."""
    res = g.residence().join(g.edges.select("etype", "eid", "w"), ["etype", "eid"])
    cut = F.size("res") > 1
    return res.groupBy("etype").agg(F.sum(cut.cast("long")).alias("n_cut"), F.sum(F.when(cut, F.col("w")).otherwise(0.0)).alias("w_cut"), F.max(F.size("res")).cast("long").alias("max_residence"))


def vertex_cut_edges(edges: DataFrame) -> DataFrame:
    """[A14] (n_remote, n_split, edge_cut): of directed edges (part, u, v) dealt to parts, those whose
    target is owned by another part, its least one, and the links of copies to their owners' vertex."""
    ends = edges.select("part", F.explode(F.array("u", "v")).alias("gid")).distinct()
    held = ends.groupBy("gid").agg(F.min("part").alias("owner"), F.count("*").alias("copies"))
    remote = edges.select("part", F.col("v").alias("gid")).join(held, "gid").where("owner <> part").agg(F.count("*").alias("n_remote"))
    split = held.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_split"))
    # one row and one row
    return remote.crossJoin(F.broadcast(split)).withColumn("edge_cut", F.col("n_remote") + F.col("n_split"))


def vertex_cut(edges: DataFrame) -> DataFrame:
    """[A14] For edges (part, u, v) dealt to parts: copies of vertices over vertices, less 1, in percent."""
    ends = edges.select("part", F.explode(F.array("u", "v")).alias("gid")).groupBy("part", "gid").agg(F.lit(1).alias("one"))
    per = ends.groupBy("gid").agg(F.count("*").alias("copies"))
    return per.agg(F.count("*").alias("n_vertices"), F.sum("copies").alias("n_copies"), (100.0 * (F.sum("copies") / F.count("*") - 1)).alias("inc_percent"))


def evaluate_partition(g: NGraph) -> DataFrame:
    """[A13] (metric, etype, max, min, avg, total, imb): the whole evaluation.

    One row of metrics a part is made first; the last aggregation sees as many rows as there
    are parts.  The total of ``cut`` counts an edge once on each part that holds it."""
    rows = [
        over_parts(g, count_disconnected(g), "n").select("part", F.lit("disconnected").alias("metric"), F.lit(-1).alias("etype"), F.col("n").cast("double").alias("v")),
        neighbors(g).select("part", F.lit("neighbors").alias("metric"), F.lit(-1).alias("etype"), F.col("n_neighbors").cast("double").alias("v")),
        weights(g, -1).select("part", F.lit("vertex_weight").alias("metric"), F.lit(-1).alias("etype"), F.col("w").alias("v")),
        weights(g, -1, ghosts=True).select("part", F.lit("total_vertex_weight").alias("metric"), F.lit(-1).alias("etype"), F.col("w").alias("v")),
    ]
    for t in range(g.num_types):
        rows.append(weights(g, t).select("part", F.lit("edge_weight").alias("metric"), F.lit(t).alias("etype"), F.col("w").alias("v")))
        rows.append(sides_total(g, t).select("part", F.lit("cut").alias("metric"), F.lit(t).alias("etype"), F.col("total").alias("v")))
    table = reduce(DataFrame.unionByName, rows)
    empty = table.where("metric = 'total_vertex_weight'").select(F.lit("empty_parts").alias("metric"), F.lit(-1).alias("etype"), (F.col("v") == 0).cast("double").alias("v"))
    table = table.select("metric", "etype", "v").unionByName(empty)
    out = table.groupBy("metric", "etype").agg(F.max("v").alias("max"), F.min("v").alias("min"), F.avg("v").alias("avg"), F.sum("v").alias("total"))
    return out.withColumn("imb", F.when(F.col("avg") != 0, F.col("max") / F.col("avg")))
