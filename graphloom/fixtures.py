"""[S17] Small synthetic graphs of known shape, for tests and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import NGraph, add_edge_type, construct_vertices


def _vertices(spark: SparkSession, parts: int, per: int = 4) -> DataFrame:
    return spark.range(parts * per).select(F.col("id").alias("gid"), F.floor(F.col("id") / per).cast("int").alias("part"))


def _edges(spark: SparkSession, g: NGraph, ends: list[tuple[int, int]]) -> NGraph:
    rows = [(i, pos, v) for i, e in enumerate(ends) for pos, v in enumerate(e)]
    pins = spark.createDataFrame(rows, "eid long, pos int, gid long")
    return add_edge_type(g, pins.select("eid", "gid") if g.is_hyper else pins)


def _hyper(spark: SparkSession, g: NGraph, edges: dict[int, list[int]], homes: dict[int, int] | None = None) -> NGraph:
    pins = spark.createDataFrame([(e, v) for e, vs in edges.items() for v in vs], "eid long, gid long")
    table = spark.createDataFrame([(e, (homes or {}).get(e, 0)) for e in edges], "eid long, home_part int")
    return add_edge_type(g, pins, table)


def ring(spark: SparkSession, parts: int) -> NGraph:
    """Four vertices a part, edges both ways around."""
    n = 4 * parts
    return _edges(spark, construct_vertices(_vertices(spark, parts), False, parts), [(v, (v + d) % n) for v in range(n) for d in (1, -1)])


def hyper(spark: SparkSession, parts: int) -> NGraph:
    """Three hyperedges a part: all four, two, and four across to the next part."""
    n, edges = 4 * parts, {}
    for s in range(parts):
        edges[3 * s] = [4 * s + i for i in range(4)]
        edges[3 * s + 1] = [4 * s + 1, 4 * s + 3]
        edges[3 * s + 2] = sorted((4 * s + i + 2) % n for i in range(4))
    return _hyper(spark, construct_vertices(_vertices(spark, parts), True, parts), edges)


def two_types(spark: SparkSession, parts: int) -> NGraph:
    """The ring, and a second type within parts and to vertex 1."""
    second = [(4 * s + i, 4 * s + (i + 2) % 4) for s in range(parts) for i in range(4)] + [(4 * s + 1, 1) for s in range(1, parts)]
    return _edges(spark, ring(spark, parts), second)


def line(spark: SparkSession, parts: int) -> NGraph:
    """Hyperedges of two along a line."""
    return _hyper(spark, construct_vertices(_vertices(spark, parts), True, parts), {v: [v, v + 1] for v in range(4 * parts - 1)})


def edge_cases(spark: SparkSession) -> NGraph:
    """Sparse ids and a hyperedge without pins."""
    v = spark.createDataFrame([(g, 0) for g in (1, 3, 5, 9)], "gid long, part int")
    return _hyper(spark, construct_vertices(v, True, 1), {3: [], 9: [1, 3, 5, 9], 27: [1, 5]})


def mostly_empty(spark: SparkSession, parts: int) -> NGraph:
    """[F8] Part 1 owns one vertex, part 2 four; the others none."""
    owned = {1: [0], 2: [1, 2, 3, 4]}
    v = spark.createDataFrame([(g, p) for p, gs in owned.items() if p < parts for g in gs] or [(0, 0)], "gid long, part int").where("part > 0")
    return _edges(spark, construct_vertices(v, False, parts), [(0, 1), (1, 0)] if parts > 2 else [])


def unbalanced_line(spark: SparkSession) -> NGraph:
    """Eight vertices on a line, three and five by part."""
    v = spark.range(8).select(F.col("id").alias("gid"), (F.col("id") > 2).cast("int").alias("part"))
    return _hyper(spark, construct_vertices(v, True, 2), {i: [i, i + 1] for i in range(7)})


def component_graph(spark: SparkSession, parts: int, comps: int) -> NGraph:
    """Hyperedge i joins one vertex of every part; vertices weigh 100 times their part."""
    v = spark.range(parts * comps).select(F.col("id").alias("gid"), F.floor(F.col("id") / comps).cast("int").alias("part"))
    v = v.withColumn("w", (100 * F.col("part")).cast("double"))
    return _hyper(spark, construct_vertices(v, True, parts), {i: [i + j * comps for j in range(parts)] for i in range(comps)})


def directed_line(spark: SparkSession) -> NGraph:
    """Eight vertices, three and five by part, edges as the language bindings' tests have them."""
    v = spark.createDataFrame([(g, int(g > 3)) for g in range(1, 9)], "gid long, part int")
    return _edges(spark, construct_vertices(v, False, 2), [(1, 2), (2, 3), (3, 4), (4, 3), (4, 5), (5, 6), (6, 7), (7, 8)])


def disconnected(spark: SparkSession) -> NGraph:
    """Two parts, with coordinates and a negative vertex.  Part 1 owns -1, 0 and an island of
    three; at vertex 0 hang four components of part 0: lines of five, three and one, and a tree."""
    lines = {100: 5, 200: 3, 400: 1}
    edges = {0: [-1, 0], 2: [1, 2, 3], 300: [0, 300]}
    edges |= {first + i: [first + i - 1 if i else 0, first + i] for first, n in lines.items() for i in range(n)}
    edges |= {301 + i: [300 + i, 301 + 2 * i, 302 + 2 * i] for i in range(3)}
    place = {-1: (0.0, 1.0), 0: (0.0, 0.0), 1: (1.0, 2.0), 2: (1.5, 2.5), 3: (1.5, 1.5), 300: (0.0, -0.5), 400: (0.0, 0.5)}
    place |= {100 + i: (-0.5 * (i + 1), 0.0) for i in range(5)} | {200 + i: (0.5 * (i + 1), 0.0) for i in range(3)}
    place |= {301: (-0.5, -1.0), 302: (0.5, -1.0)} | {303 + i: (0.5 * i - 0.75, -2.0) for i in range(4)}
    rows = [(v, int(v < 100), x, y, 0.0) for v, (x, y) in place.items()]
    g = construct_vertices(spark.createDataFrame(rows, "gid long, part int, x double, y double, z double"), True, 2)
    homes = {e: int(e < 100) for e in edges}
    return _hyper(spark, g, edges, homes)
