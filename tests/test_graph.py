"""Golden counts of small graphs, traversal, tags and construction."""

import pytest
from pyspark.sql import functions as F

from graphloom import fixtures
from graphloom.graph import add_edge_type, construct_vertices, empty_graph, flat_edges, remove_edge_type
from graphloom.operators import access, adjacency, metrics, migrate
from graphloom.operators.validity import validity
from graphloom.schema import GraphError


def table(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def counts(g, kind, etype=-1):
    return [r["n"] for r in metrics.counts_per_part(g).where((F.col("kind") == kind) & (F.col("etype") == etype)).orderBy("part").collect()]


@pytest.mark.parametrize("parts,ghosts", [(1, 0), (2, 2), (4, 2)])
def test_ring(spark, parts, ghosts):
    g = fixtures.ring(spark, parts)
    assert counts(g, "vertices") == [4] * parts
    assert counts(g, "ghosts") == [ghosts] * parts
    assert counts(g, "edges", 0) == [8] * parts
    assert counts(g, "pins", 0) == [16] * parts
    assert table(metrics.global_counts(g), "n_edges", "n_pins") == [(8 * parts, 16 * parts)]
    if parts == 4:
        assert {(r["part"], r["side"]) for r in metrics.sides(g).collect()} == {(p, 1.0) for p in range(4)}


@pytest.mark.parametrize("parts,ghosts,edges,pins", [(1, 0, 3, 10), (2, 4, 4, 14), (4, 4, 4, 14)])
def test_hyper(spark, parts, ghosts, edges, pins):
    g = fixtures.hyper(spark, parts)
    assert counts(g, "ghosts") == [ghosts] * parts
    assert counts(g, "edges", 0) == [edges] * parts
    assert counts(g, "pins", 0) == [pins] * parts
    assert table(metrics.global_counts(g), "n_edges", "n_pins") == [(3 * parts, 10 * parts)]
    assert [r["degree"] for r in access.vertex_degree(g, 0).orderBy("gid").limit(4).collect()] == [2, 3, 2, 3]


def test_line_metrics(spark):
    g = fixtures.line(spark, 4)
    assert counts(g, "ghosts") == [1, 2, 2, 1]
    assert counts(g, "edges", 0) == [4, 5, 5, 4]
    assert [round(r["imb"], 4) for r in metrics.imbalances(g).orderBy("dim").collect()] == [1.0, 1.1111]


def test_unbalanced_line(spark):
    g = fixtures.unbalanced_line(spark)
    assert [r["imb"] for r in metrics.imbalances(g).orderBy("dim").collect()] == [1.25, 1.25]
    assert table(metrics.sides(g), "part", "nbr", "side") == [(0, 1, 1.0), (1, 0, 1.0)]


def test_two_types_and_removal(spark):
    g = fixtures.two_types(spark, 4)
    assert counts(g, "ghosts") == [2, 3, 3, 3]
    assert counts(g, "edges", 1) == [4, 5, 5, 5]
    less = remove_edge_type(g, 0)
    assert less.num_types == 2 and less.edges.where("etype = 0").count() == 0
    assert remove_edge_type(g, 1).num_types == 1


def test_edge_without_pins_and_empty_graph(spark):
    g = fixtures.edge_cases(spark)
    assert table(access.edge_degree(g, 0), "eid", "degree") == [(3, 0), (9, 4), (27, 2)]
    assert counts(g, "edges", 0) == [3]
    assert empty_graph(spark).vertices.count() == 0
    assert all(r["violations"] == 0 for r in validity(g).collect())


def test_empty_parts_count(spark):
    g = fixtures.mostly_empty(spark, 4)
    assert [r["w"] for r in metrics.weights(g, -1).orderBy("part").collect()] == [0.0, 1.0, 4.0, 0.0]
    assert metrics.imbalance_of(metrics.weights(g, -1), 4).head()[0] == pytest.approx(4 / 1.25)
    assert [r["n"] for r in metrics.count_disconnected(g).orderBy("part").collect()] == [-1, 0, 3, -1]


def test_adjacency(spark):
    g = fixtures.hyper(spark, 2)
    full, once = adjacency.vev(g, 0, compress=False), adjacency.vev(g, 0)
    assert full.where("gid = nbr").count() == 20
    assert table(once, "gid", "nbr") == table(full.where("gid <> nbr").distinct(), "gid", "nbr")
    assert adjacency.vev_full_count(g, 0).agg(F.sum("n")).head()[0] == full.count()


def test_ghost_tags(spark):
    g = fixtures.hyper(spark, 2)
    assert table(access.ghost_tag(g, F.col("gid").cast("double")), "gid", "tag") == sorted((r["gid"], float(r["gid"])) for r in g.ghosts().collect())
    with pytest.raises(GraphError):
        access.set_tag(g.vertices, "t", F.lit("x"), kind="string")


def test_flat_edges_and_limits(spark):
    flat = spark.createDataFrame([([7, 8], [2, 3], [1, 2, 1, 2, 3])], "eids array<long>, degrees array<int>, pins array<long>")
    assert table(flat_edges(flat), "eid", "pos", "gid") == [(7, 0, 1), (7, 1, 2), (8, 0, 1), (8, 1, 2), (8, 2, 3)]
    g = construct_vertices(spark.range(3).select(F.col("id").alias("gid"), F.lit(0).alias("part")), True, 1)
    pins = spark.createDataFrame([(0, 0), (0, 0), (0, 1)], "eid long, gid long")
    for _ in range(7):
        g = add_edge_type(g, pins)
    assert g.typed(g.pins, 0).count() == 2
    with pytest.raises(GraphError):
        add_edge_type(g, pins)


def test_migration(spark):
    g = fixtures.hyper(spark, 2)
    plan = spark.createDataFrame([(0, 1, 0), (5, 0, 1)], "gid long, dest int, seq long")
    h = migrate.migrate(g, plan)
    assert table(migrate.partition_map(h).where("part <> orig_part"), "gid", "part") == [(0, 1), (5, 0)]
    assert h.vertices.agg(F.sum("w")).head()[0] == 8
    assert all(r["violations"] == 0 for r in validity(h).collect())
    both = migrate.affected_edges(g, plan).count() + migrate.unaffected_edges(g, plan).count()
    assert both == g.edges.count()
    with pytest.raises(GraphError):
        migrate.migrate(g, plan.withColumn("dest", F.lit(9)))
    again = migrate.plan_of(spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "gid long, dest int, seq long"))
    assert table(again, "gid", "dest", "seq") == [(1, 1, 0)]
