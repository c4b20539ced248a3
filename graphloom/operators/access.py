"""Accessors, degrees, tags and first-order traversal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import NGraph
from ..schema import GraphError, check_etype


def set_weights(g: NGraph, weights: DataFrame | Column) -> NGraph:
    """[P3] Replace all vertex weights, by an expression or by a table (gid, w); a vertex that isn't there gets 1."""
    if isinstance(weights, Column):
        return g.with_(vertices=g.vertices.withColumn("w", weights.cast("double")))
    new = weights.select("gid", F.col("w").cast("double").alias("new_w"))
    out = g.vertices.join(new, "gid", "left").withColumn("w", F.coalesce("new_w", F.lit(1.0))).select(g.vertices.columns)
    return g.with_(vertices=out)


def set_edge_weights(g: NGraph, weights: DataFrame | float, etype: int) -> NGraph:
    """[P9] Replace the weights of one edge type: one number, or a table (eid, w)."""
    mine = F.col("etype") == check_etype(etype, g.num_types)
    if isinstance(weights, (int, float)):
        return g.with_(edges=g.edges.withColumn("w", F.when(mine, F.lit(float(weights))).otherwise(F.col("w"))))
    new = weights.select(F.lit(etype).alias("etype"), "eid", F.col("w").cast("double").alias("new_w"))
    return g.with_(edges=g.edges.join(new, ["etype", "eid"], "left").withColumn("w", F.coalesce("new_w", "w")).select(g.edges.columns))


def set_coords(g: NGraph, coords: DataFrame) -> NGraph:
    """[P2] Coordinates (gid, x, y, z); a vertex that isn't there loses its own."""
    return g.with_(vertices=g.vertices.drop("x", "y", "z").join(coords.select("gid", *(F.col(c).cast("double") for c in "xyz")), "gid", "left").select(g.vertices.columns))


def set_original_owners(g: NGraph) -> NGraph:
    """[P5] Take the owners of now as the original ones where there are none."""
    return g.with_(vertices=g.vertices.withColumn("orig_part", F.coalesce("orig_part", "part")))


def reset_ownership(g: NGraph) -> NGraph:
    """[P5] Take the owners of now as the original ones."""
    return g.with_(vertices=g.vertices.withColumn("orig_part", F.col("part")))


def change_owners(g: NGraph, new_parts: DataFrame) -> NGraph:
    """[P14] Rename parts by (part, new_part)."""
    out = g.vertices.join(new_parts.select("part", "new_part"), "part", "left").withColumn("part", F.coalesce("new_part", "part").cast("int"))
    return g.with_(vertices=out.select(g.vertices.columns))


def find(g: NGraph, *gids: int) -> DataFrame:
    """[P6] Vertices by id; the filter reaches the scan."""
    return g.vertices.where(F.col("gid").isin(list(gids)))


def incident_edges(g: NGraph, etype: int) -> DataFrame:
    """[J1] (gid, eid): edges of a vertex; edges with a direction count at their source."""
    pins = g.typed(g.pins, etype)
    return (pins if g.is_hyper else pins.where("pos = 0")).select("gid", "eid")


def pins_of_edges(g: NGraph, etype: int) -> DataFrame:
    """[J2] (eid, w, gid): pins with the weight of their edge."""
    return g.typed(g.edges, etype).select("eid", "w").join(g.typed(g.pins, etype).select("eid", "gid"), "eid")


def vertex_degree(g: NGraph, etype: int) -> DataFrame:
    """[A3] (gid, degree), with the vertices that have no edges."""
    count = incident_edges(g, etype).groupBy("gid").agg(F.count("*").alias("n"))
    return g.vertices.select("gid").join(count, "gid", "left").select("gid", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def edge_degree(g: NGraph, etype: int) -> DataFrame:
    """[A4] (eid, degree), with edges that have no pins."""
    count = g.typed(g.pins, etype).groupBy("eid").agg(F.count("*").alias("n"))
    return g.typed(g.edges, etype).select("eid").join(count, "eid", "left").select("eid", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def is_cut(g: NGraph, etype: int) -> DataFrame:
    """[P11] (eid, cut): whether two pins have different owners."""
    ends = g.pin_owner(etype).groupBy("eid").agg((F.min("part") < F.max("part")).alias("c"))
    return g.typed(g.edges, etype).select("eid").join(ends, "eid", "left").select("eid", F.coalesce("c", F.lit(False)).alias("cut"))


def is_resident_on(g: NGraph, etype: int, part: int) -> DataFrame:
    """[P12] (eid): edges with a pin that ``part`` owns."""
    return g.resident(etype).where(F.col("part") == part).select("eid")


def ghost_weights(g: NGraph, etype: int | None = None) -> DataFrame:
    """[S4, P1] (part, gid, owner, w): ghosts with their weight, from the owner."""
    return g.ghosts(etype).join(g.vertices.select("gid", "w"), "gid").select("part", "gid", "owner", "w")


def set_tag(table: DataFrame, name: str, tag: DataFrame | Column, keys: tuple[str, ...] = ("gid",), kind: str = "double") -> DataFrame:
    """[U2] A tag of kind int, long or double as a column of vertices or edges."""
    if kind not in ("int", "bigint", "long", "double"):
        raise GraphError(f"tags are int, long or double, not {kind}")
    if isinstance(tag, Column):
        return table.withColumn(name, tag.cast(kind))
    return table.drop(name).join(tag.select(*keys, F.col(name).cast(kind)), list(keys), "left")


def ghost_tag(g: NGraph, value: Column | Callable[[DataFrame], DataFrame], name: str = "tag", etype: int | None = None) -> DataFrame:
    """[J7, U1] (part, gid, owner, tag): each ghost with a value that its owner computes,
    by an expression over vertices or a function from the vertices to (gid, tag)."""
    owned = g.vertices.select("gid", value.alias(name)) if isinstance(value, Column) else value(g.vertices)
    return g.ghosts(etype).join(owned.select("gid", name), "gid").select("part", "gid", "owner", name)
