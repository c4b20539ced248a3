"""Round trips of files, and mesh converters."""

import struct

import pytest
from pyspark.sql import functions as F

from graphloom import fixtures
from graphloom.schema import GraphError
from graphloom.sinks import write_bgd, write_ebin, write_vtk
from graphloom.sources import dof_graph, ebin_graph, mesh_graph, read_bgd, read_coords, read_partition


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("make", [lambda s: fixtures.hyper(s, 2), lambda s: fixtures.ring(s, 2), fixtures.edge_cases])
def test_bgd(spark, tmp_path, make):
    g = make(spark)
    assert write_bgd(g, f"{tmp_path}/new/g") == g.num_parts
    h = read_bgd(spark, f"{tmp_path}/new/g")
    assert h.is_hyper == g.is_hyper and h.num_parts == g.num_parts and h.num_types == g.num_types
    assert rows(h.vertices) == rows(g.vertices)
    if g.is_hyper:
        assert rows(h.pins.select("eid", "gid")) == rows(g.pins.select("eid", "gid"))
        assert rows(h.edges.select("eid", "w")) == rows(g.edges.select("eid", "w"))
    else:
        ends = lambda x: rows(x.pins.groupBy("eid").agg(F.sort_array(F.collect_list(F.struct("pos", "gid"))).alias("e")).select("e"))
        assert ends(h) == ends(g)


def test_bgd_refuses_negative_ids(spark, tmp_path):
    g = fixtures.hyper(spark, 1)
    with pytest.raises(GraphError):
        write_bgd(g.with_(vertices=g.vertices.withColumn("gid", F.col("gid") - 1)), f"{tmp_path}/g")


def test_ebin_partition_coords(spark, tmp_path):
    edges = [(0, 1), (1, 2), (2, 0), (5, 1)]
    assert write_ebin(spark.createDataFrame(edges, "u long, v long"), f"{tmp_path}/e.ebin") == 4
    assert (tmp_path / "e.ebin").read_bytes() == b"".join(struct.pack("<ii", *e) for e in sorted(edges))
    (tmp_path / "p.txt").write_text("".join(f"{i % 2}\n" for i in range(6)))
    g = ebin_graph(spark, f"{tmp_path}/e.ebin", 2, f"{tmp_path}/p.txt")
    assert rows(g.vertices.select("gid", "part")) == [(i, i % 2) for i in range(6)]
    assert ebin_graph(spark, f"{tmp_path}/e.ebin", 2).vertices.where("part = 0").count() == 4
    assert rows(read_partition(spark, f"{tmp_path}/p.txt"))[1] == (1, 1)
    (tmp_path / "c.txt").write_text("0 1 2\n3 4 5\n")
    assert rows(read_coords(spark, f"{tmp_path}/c.txt")) == [(0, 0.0, 1.0, 2.0), (1, 3.0, 4.0, 5.0)]


def test_vtk(spark, tmp_path):
    assert write_vtk(fixtures.hyper(spark, 2), f"{tmp_path}/v/g") == 2
    text = (tmp_path / "v/g_0.vtu").read_text()
    assert 'NumberOfPoints="8" NumberOfCells="10"' in text
    assert (tmp_path / "v/g.pvtu").read_text().count("<Piece") == 2


def test_meshes(spark):
    # two tetrahedra (dim 3) on four and four of five corners (dim 0)
    entities = spark.createDataFrame([(3, 0, 0), (3, 1, 1)] + [(0, i, 0) for i in range(5)], "dim int, id long, part int")
    incidence = spark.createDataFrame([(3, e, 0, v) for e in (0, 1) for v in range(e, e + 4)], "dim_a int, id_a long, dim_b int, id_b long")
    g = mesh_graph(entities, incidence, 3, [0], 2)
    assert g.edges.count() == 5 and g.pins.count() == 8
    assert dof_graph(entities, incidence, 1, 2).edges.agg(F.sum("w")).head()[0] == 5
    for primary, secondary in ((7, [0]), (3, [9]), (3, [3])):
        with pytest.raises(GraphError):
            mesh_graph(entities, incidence, primary, secondary, 2)
