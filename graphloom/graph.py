"""NGraph: vertices, typed edges and pins as three DataFrames, and the views derived from them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .iterate import shares, spread
from .schema import EDGES, MAX_TYPES, PINS, VERTICES, GraphError, check_etype


@dataclass(frozen=True)
class NGraph:
    """An immutable graph.  A part is a value of ``vertices.part``, not a Spark partition."""

    vertices: DataFrame
    edges: DataFrame
    pins: DataFrame
    is_hyper: bool
    num_parts: int
    num_types: int

    def with_(self, **changes) -> NGraph:
        return replace(self, **changes)

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    # -- views ------------------------------------------------------------------

    def typed(self, df: DataFrame, etype: int | None) -> DataFrame:
        return df if etype is None else df.where(F.col("etype") == check_etype(etype))

    def pin_owner(self, etype: int | None = None) -> DataFrame:
        """(etype, eid, pos, gid, part): pins with the part that owns their vertex."""
        return self.typed(self.pins, etype).join(self.vertices.select("gid", "part"), "gid").select("etype", "eid", "pos", "gid", "part")

    def residence(self, etype: int | None = None) -> DataFrame:
        """[A5] (etype, eid, res): the sorted parts that own a pin."""
        return self.pin_owner(etype).groupBy("etype", "eid").agg(F.array_sort(F.collect_set("part")).alias("res"))

    def resident(self, etype: int | None = None) -> DataFrame:
        """(etype, eid, part), distinct: the residence in rows."""
        return self.pin_owner(etype).select("etype", "eid", "part").distinct()

    def edge_copy(self, etype: int | None = None) -> DataFrame:
        """(etype, eid, part, w, deg): one row for each part that holds a copy of an edge.
        Hyperedges: where a pin is owned, or at home if there is none; other edges: at their source."""
        edges = self.typed(self.edges, etype)
        if not self.is_hyper:
            source = self.pin_owner(etype).where("pos = 0").select("etype", "eid", "part")
            return edges.join(source, ["etype", "eid"]).select("etype", "eid", "part", "w", F.lit(2).cast("long").alias("deg"))
        held = self.pin_owner(etype).groupBy("etype", "eid", "part").agg(F.count("*").alias("own"))
        degree = self.typed(self.pins, etype).groupBy("etype", "eid").agg(F.count("*").alias("deg"))
        some = held.join(degree, ["etype", "eid"])
        out = edges.join(some.select("etype", "eid", "part", "deg"), ["etype", "eid"], "left")
        return out.select("etype", "eid", F.coalesce("part", "home_part").alias("part"), "w", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))

    def ghosts(self, etype: int | None = None) -> DataFrame:
        """(part, gid, owner): vertices on a part's edge copies that another part owns."""
        # a hyperedge without pins has no ghosts, so that its copies needn't be known, nor weights and degrees
        held = self.resident(etype) if self.is_hyper else self.edge_copy(etype)
        copies = held.select("etype", "eid", F.col("part").alias("copy_part"))
        out = self.pin_owner(etype).join(copies, ["etype", "eid"]).where("part <> copy_part")
        return out.select(F.col("copy_part").alias("part"), "gid", F.col("part").alias("owner")).distinct()

    def parts(self) -> DataFrame:
        """(part), every part, empty ones too: ``num_parts`` rows."""
        return self.spark.range(self.num_parts).select(F.col("id").cast("int").alias("part"))


# -- construction ---------------------------------------------------------------------


def empty_graph(spark: SparkSession, num_parts: int = 1) -> NGraph:
    """[S1] No vertices, no edge types."""
    return NGraph(spark.createDataFrame([], VERTICES), spark.createDataFrame([], EDGES), spark.createDataFrame([], PINS), True, num_parts, 0)


def construct_vertices(vertices: DataFrame, is_hyper: bool, num_parts: int) -> NGraph:
    """[S2] Start a graph from (gid, part) and optionally w (null: 1), orig_part, x, y, z."""
    has = set(vertices.columns)
    spark = vertices.sparkSession

    def pick(name: str, kind: str, default: Column) -> Column:
        return (F.coalesce(F.col(name).cast(kind), default) if name in has else default).cast(kind).alias(name)

    null = F.lit(None)
    table = vertices.select(F.col("gid").cast("long"), pick("w", "double", F.lit(1.0)), F.col("part").cast("int"), pick("orig_part", "int", F.col("part")), *(pick(c, "double", null) for c in "xyz"))
    return NGraph(table, spark.createDataFrame([], EDGES), spark.createDataFrame([], PINS), is_hyper, num_parts, 0)


def add_edge_type(g: NGraph, pins: DataFrame, edges: DataFrame | None = None) -> NGraph:
    """[S3] A further edge type from (eid, gid[, pos]); hyperedges hold a vertex once.
    ``edges``: (eid[, w, home_part]), with the edges that have no pins; weights default to 1."""
    etype = g.num_types
    if etype >= MAX_TYPES:
        raise GraphError(f"a graph has {MAX_TYPES} edge types at most")
    if "pos" in pins.columns:
        own = pins.select(F.lit(etype).alias("etype"), F.col("eid").cast("long"), F.col("pos").cast("int"), F.col("gid").cast("long"))
    elif g.is_hyper:
        # a pin's place means nothing in a hyperedge; many are dealt by vertex, for whose join they needn't move again
        own = pins.select(F.lit(etype).alias("etype"), F.col("eid").cast("long"), F.lit(None).cast("int").alias("pos"), F.col("gid").cast("long"))
        own = spread(own, shares(pins), "gid").distinct()
    else:
        raise GraphError("edges with a direction need pos 0 and 1")
    if edges is None:
        made = pins.select(F.lit(etype).alias("etype"), F.col("eid").cast("long")).distinct().select("etype", "eid", F.lit(1.0).alias("w"), F.lit(0).alias("home_part"))
    else:
        w = F.coalesce(F.col("w").cast("double"), F.lit(1.0)) if "w" in edges.columns else F.lit(1.0)
        home = F.coalesce(F.col("home_part").cast("int"), F.lit(0)) if "home_part" in edges.columns else F.lit(0)
        made = edges.select(F.lit(etype).alias("etype"), F.col("eid").cast("long"), w.alias("w"), home.alias("home_part"))
    return g.with_(pins=g.pins.unionByName(own) if etype else own, edges=g.edges.unionByName(made) if etype else made, num_types=etype + 1)


def flat_edges(edges: DataFrame) -> DataFrame:
    """[S3] Pins (eid, pos, gid) from whole arrays: one row (eids, degrees, pins) holds an
    edge list with all degrees and all pins one after another, as array interfaces give it."""
    ends = F.transform(F.sequence(F.lit(1), F.size("eids")), lambda i: F.aggregate(F.slice("degrees", 1, i), F.lit(0), lambda a, x: a + x.cast("int")))
    rows = edges.where(F.size("eids") > 0).select("pins", F.explode(F.arrays_zip("eids", "degrees", ends.alias("ends"))).alias("e"))
    rows = rows.select(F.col("e.eids").alias("eid"), F.slice("pins", F.col("e.ends") - F.col("e.degrees").cast("int") + 1, F.col("e.degrees").cast("int")).alias("own"))
    return rows.select("eid", F.posexplode("own").alias("pos", "gid"))


def construct_graph(vertices: DataFrame, types: list[DataFrame], is_hyper: bool, num_parts: int) -> NGraph:
    """[S5] Vertices and one pin table for each edge type, unit weights on edges."""
    g = construct_vertices(vertices, is_hyper, num_parts)
    for pins in types:
        g = add_edge_type(g, pins)
    return g


def remove_edge_type(g: NGraph, etype: int) -> NGraph:
    """[P15] Drop a type; its slot stays, without edges, unless it was the last."""
    check_etype(etype, g.num_types)
    keep = F.col("etype") != etype
    return g.with_(edges=g.edges.where(keep), pins=g.pins.where(keep), num_types=g.num_types - (etype == g.num_types - 1))


def undirected(g: NGraph) -> NGraph:
    """[P16] Every edge beside its reverse (new ids follow the largest); hypergraphs stay as they are."""
    if g.is_hyper:
        return g
    wide = source_target(g)
    missing = wide.select("etype", F.col("v").alias("u"), F.col("u").alias("v")).distinct().join(wide.select("etype", "u", "v").distinct(), ["etype", "u", "v"], "left_anti")
    top = g.edges.agg(F.max("eid")).head()[0] or 0
    # xxhash64 gives ids that don't depend on the partitioning, above all that exist
    fresh = missing.withColumn("eid", F.lit(top + 1) + F.pmod(F.xxhash64("etype", "u", "v"), F.lit(1 << 61)))
    pins = fresh.select("etype", "eid", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.col("u").alias("gid")), F.struct(F.lit(1).alias("pos"), F.col("v").alias("gid")))).alias("p")).select("etype", "eid", "p.pos", "p.gid")
    edges = fresh.select("etype", "eid", F.lit(1.0).alias("w"), F.lit(0).alias("home_part"))
    return g.with_(edges=g.edges.unionByName(edges), pins=g.pins.unionByName(pins))


def source_target(g: NGraph, etype: int | None = None) -> DataFrame:
    """[P8] (etype, eid, u, v): source and target of directed edges."""
    if g.is_hyper:
        raise GraphError("hyperedges have no source and target")
    ends = g.typed(g.pins, etype).groupBy("etype", "eid")
    return ends.agg(F.max(F.when(F.col("pos") == 0, F.col("gid"))).alias("u"), F.max(F.when(F.col("pos") == 1, F.col("gid"))).alias("v"))
