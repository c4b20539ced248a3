"""Balancing, weight diffusion, splitting, colouring: by their properties."""

import pytest
from pyspark.sql import functions as F

from graphloom import fixtures
from graphloom.graph import add_edge_type, construct_vertices
from graphloom.operators import coloring, metrics, traverse
from graphloom.operators.validity import validity
from graphloom.plans import DiffusiveInput, Stagnation, WeightInput, diffusive, split, weight_diffusion
from graphloom.timers import Timers


@pytest.fixture(scope="module")
def grid(spark):
    """A grid of 20 by 20, hyperedges of two, owned 70 and 30 % by two parts."""
    v = spark.range(400).select(F.col("id").alias("gid"), F.when(F.col("id") < 280, 0).otherwise(1).alias("part"))
    right = [(2 * i, i, i + 1) for i in range(400) if i % 20 < 19]
    down = [(2 * i + 1, i, i + 20) for i in range(380)]
    pins = spark.createDataFrame([(e, x) for e, *ends in right + down for x in ends], "eid long, gid long")
    return add_edge_type(construct_vertices(v, True, 2), pins)


def test_stagnation():
    s = Stagnation()
    for x in (1.5, 1.4, 1.3):
        s.push(x)
    assert not s.stagnated()
    s.push(1.6)
    assert s.values == [1.4, 1.3, 1.6] and s.slope() == pytest.approx(-1.5 * 1.4 + 2 * 1.6 - 0.5 * 1.3) and s.stagnated()


def test_balance(spark, grid):
    assert diffusive.imbalance(grid, -1) == pytest.approx(1.4)
    done = diffusive.balance(grid, DiffusiveInput(((-1, 1.1),), max_iterations_per_type=12, step_factor=0.6))
    assert diffusive.imbalance(done, -1) < 1.11
    assert done.vertices.agg(F.sum("w")).head()[0] == 400
    assert all(r["violations"] == 0 for r in validity(done).collect())
    assert done.vertices.where("orig_part is null").count() == 0


def test_one_part_is_left_alone(spark):
    g = fixtures.hyper(spark, 1)
    assert diffusive.balance(g).vertices.where("part <> 0").count() == 0


def test_trim_and_cancel(spark, grid):
    plan = grid.vertices.where("part = 0 and gid >= 240").select("part", "gid", F.lit(1).alias("dest"), F.col("gid").alias("seq"))
    grants = diffusive.trim(grid, plan, {-1: 130.0})
    assert grants == {(0, 1): {-1: 10.0}}
    kept = diffusive.cancel(grid, plan, grants)
    assert sorted(r["gid"] for r in kept.collect()) == list(range(240, 250))


def test_queues(spark, grid):
    cut = {(r["part"], r["eid"]) for r in traverse.boundary_edges(grid).collect()}
    far = diffusive.distance_queue(grid).collect()
    assert {(r["part"], r["eid"]) for r in far} == cut
    assert sorted(r["rank"] for r in far if r["part"] == 0) == list(range(1, 21))


@pytest.mark.parametrize("comps", [1, 4])
def test_weight_balance(spark, comps):
    g = fixtures.component_graph(spark, 3, comps)
    done, plan = weight_diffusion.balance_weights(g, WeightInput(tolerance=1.025, step_factor=0.25, max_iterations=4))
    assert done.vertices.agg(F.sum("w")).head()[0] == pytest.approx(300 * comps)
    assert diffusive.imbalance(done, -1) < diffusive.imbalance(g, -1)
    assert plan.where("w <= 0").count() == 0 and plan.count() > 0


def test_weight_balance_of_parts(spark):
    """A graph of components whose parts weigh 100, 200, 300 and 400 a vertex."""
    n = 25
    v = spark.range(4 * n).select(F.col("id").alias("gid"), F.floor(F.col("id") / n).cast("int").alias("part"), (100.0 * (1 + F.floor(F.col("id") / n))).alias("w"))
    g = add_edge_type(construct_vertices(v, True, 4), v.select((F.col("gid") % n).alias("eid"), "gid"))
    done, plan = weight_diffusion.balance_weights(g, WeightInput(tolerance=1.025, step_factor=0.25, max_iterations=5))
    assert done.vertices.agg(F.sum("w")).head()[0] == pytest.approx(1000 * n)
    assert diffusive.imbalance(done, -1) < diffusive.imbalance(g, -1) and plan.count() > 0


def test_weight_balance_query(spark, monkeypatch):
    """The query balances all orders, with the method's own limit of steps."""
    from graphloom.queries import QUERIES

    seen = []
    monkeypatch.setattr(weight_diffusion, "balance_weights", lambda g, given=WeightInput(): seen.append((g, given)) or (g, None))
    QUERIES["x16_balance_weights"](spark, "/root/testdata/sf0.001")
    (g, given), orders = seen[0], spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    both = g.vertices.join(orders, F.col("gid") == F.col("o_orderkey")).where("w = o_totalprice").count()
    assert both == g.vertices.count() == orders.count()
    assert given.max_iterations == WeightInput().max_iterations and diffusive.imbalance(g, -1) > 1.5
    flows = weight_diffusion.select_flows(g, weight_diffusion.targets(g, -1, 0, 0.25, 10 * g.edges.count()))
    assert flows.where("w > 0").count() > 0


def test_part_flows(spark, grid):
    rows = weight_diffusion.part_flows(grid).collect()
    assert [(r["part"], r["nbr"]) for r in rows] == [(0, 1)] and 0 < rows[0]["w"] <= 80.0001


def test_split(spark, grid):
    eight = split.split(grid, 4, refine=False)
    assert diffusive.imbalance(eight, -1) < 1.11
    local = split.split_local(grid, 2)
    assert local.num_parts == 4
    assert local.vertices.where("floor(part / 2) <> orig_part").count() == 0
    assert metrics.edge_cut(eight).head()["n_cut"] < 300


def test_coloring(spark, grid):
    colors = coloring.color_vertices(grid)
    assert colors.count() == 400 and colors.where("color is null").count() == 0
    assert coloring.vertex_conflicts(grid, colors).count() == 0
    small = fixtures.hyper(spark, 2)
    assert coloring.edge_conflicts(small, coloring.color_edges(small)).count() == 0


def test_traversal(spark):
    g = fixtures.ring(spark, 2)
    assert sorted((r["gid"], r["depth"]) for r in traverse.bfs(g, 0).collect()) == [(i, min(i, 8 - i)) for i in range(8)]
    assert traverse.pagerank(g).agg(F.sum("rank")).head()[0] == pytest.approx(1)
    assert traverse.is_directed(g).head()["n_one_way"] == 0


def test_bfs_query_has_no_depth_bound(spark, monkeypatch):
    """A line of 20 vertices is searched to its end."""
    from graphloom import queries

    v = spark.range(20).select(F.col("id").alias("gid"), F.lit(0).alias("part"))
    pins = spark.range(19).select(F.col("id").alias("eid"), F.posexplode(F.array("id", F.col("id") + 1)).alias("pos", "gid"))
    monkeypatch.setattr(queries.views, "t1", lambda spark, d: add_edge_type(construct_vertices(v, False, 1), pins))
    assert sorted((r["gid"], r["depth"]) for r in queries.QUERIES["t6_bfs_depth"](spark, "").collect()) == [(i, i) for i in range(20)]


def test_balance_two_priorities(grid):
    """Edges first and vertices then, at a tolerance of 1.1: either meets it, and the graph stays valid."""
    timers = Timers()
    done = diffusive.balance(grid, DiffusiveInput(((0, 1.1), (-1, 1.1)), max_iterations_per_type=12, step_factor=0.6), timers)
    assert diffusive.imbalance(done, 0) < 1.11 and diffusive.imbalance(done, -1) < 1.11
    assert all(r["violations"] == 0 for r in validity(done).collect())
    assert done.vertices.count() == 400 and {n for n, *_ in timers.rows()} >= {"selection", "migration"}


def test_balance_by_part_weights(grid):
    given = DiffusiveInput(((-1, 1.1),), max_iterations_per_type=12, step_factor=0.6, part_weight_balancer=True, count_ghosts=False)
    done = diffusive.balance(grid, given)
    assert diffusive.imbalance(done, -1) < 1.11


def test_weights_with_ghosts(grid):
    own, more = (diffusive.imbalance(grid, -1, x) for x in (False, True))
    w = {r["part"]: r["w"] for r in metrics.weights(grid, -1, ghosts=True).collect()}
    assert own == pytest.approx(1.4) and more == pytest.approx(max(w.values()) * 2 / sum(w.values())) and sum(w.values()) == 440


def test_disconnected_fixture(spark):
    g = fixtures.disconnected(spark)
    assert {r["part"]: r["count"] for r in g.vertices.groupBy("part").count().collect()} == {0: 16, 1: 5}
    assert {r["part"]: r["n"] for r in traverse.count_disconnected(g).collect()} == {0: 3, 1: 1}
    far = diffusive.distance_queue(g).where("part = 0").orderBy("rank").collect()
    again = diffusive.distance_queue(g.with_(pins=g.pins.repartition(7, "gid"))).where("part = 0").orderBy("rank").collect()
    assert {r["eid"] for r in far} == {100, 200, 300, 400} and far == again


def test_connections_and_disconnected_cavities(spark):
    """Pairs of a cavity with one end outside; a cavity goes once all of them have an end that goes."""
    v = spark.createDataFrame([(i, int(i >= 4)) for i in range(8)], "gid long, part int")
    pins = {0: [2, 4], 1: [2, 3], 2: [2, 3], 3: [0, 1], 4: [4, 5], 5: [1, 6], 6: [6, 7]}
    g = add_edge_type(construct_vertices(v, True, 2), spark.createDataFrame([(e, x) for e, xs in pins.items() for x in xs], "eid long, gid long"))
    cut = traverse.boundary_edges(g)
    got = {(r["part"], r["eid"], r["u"], r["v"], r["n"]) for r in diffusive.cavity_connections(g, cut, least=2).collect()}
    assert got == {(0, 0, 2, 3, 1)}
    # no targets are left for what is chosen by weight, but part 0's vertex 1 has no pair that holds it
    goals = spark.createDataFrame([(0, 1, 0.0)], "part int, nbr int, target double")
    plan = diffusive.select(g, goals, cut, min_connectivity=2).collect()
    assert [(r["part"], r["gid"], r["dest"]) for r in plan] == [(0, 1, 1)]
    assert diffusive.select(g, goals, cut).count() == 0


def test_visit(spark):
    g = fixtures.ring(spark, 3)
    seen = []
    traverse.bfs(g, 0, visit=lambda depth, new: seen.append((depth, sorted(r["gid"] for r in new.collect()))))
    assert seen[:2] == [(1, [1, 11]), (2, [2, 10])]
    assert traverse.bfs(g, 0, visit=lambda depth, new: depth < 2).agg(F.max("depth")).head()[0] == 2


def test_vertex_cut_edges(spark):
    dealt = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (1, 2, 4), (1, 4, 1)], "part int, u long, v long")
    assert tuple(metrics.vertex_cut_edges(dealt).head()) == (1, 2, 3)


def test_work_dir_is_shared(spark, monkeypatch):
    from graphloom import iterate

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = {}, Context

    with pytest.raises(ValueError):
        iterate.work_dir(Session)


def test_command_line(spark, tmp_path, capsys):
    from graphloom.__main__ import main
    from graphloom.sinks import write_bgd
    from graphloom.sources import read_bgd

    write_bgd(fixtures.hyper(spark, 2), f"{tmp_path}/g")
    assert main(["balance", f"{tmp_path}/g", f"{tmp_path}/out", "--tolerance", "1.5"]) == 0
    assert "vertex_weight" in capsys.readouterr().out and read_bgd(spark, f"{tmp_path}/out").vertices.count() == 8
