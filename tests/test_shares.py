"""Tasks' shares of large tables, and tables that are read once."""

import pytest
from pyspark.sql import functions as F

from graphloom import iterate, views
from graphloom.sinks import edge_centroids

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def dealt(monkeypatch):
    """Shares as small as if the tables were large."""
    monkeypatch.setattr(iterate, "SHARE", 2048)


def test_pins_of_large_tables_are_dealt_to_more_tasks(spark, dealt, monkeypatch):
    want = rows(spark.read.parquet(f"{D}/lineitem.parquet").join(spark.read.parquet(f"{D}/part.parquet"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("eid"), "l_partkey", "p_size").distinct().groupBy("eid").agg(F.round(F.avg("p_size"), 6)))
    g = views.h1(spark, D)
    n = iterate.shares(spark.read.parquet(f"{D}/lineitem.parquet"))
    assert n > 8 and g.typed(g.pins, 0).rdd.getNumPartitions() >= n
    assert rows(edge_centroids(g, 0).select("eid", F.round("cx", 6))) == want
    monkeypatch.setattr(iterate, "SHARE", 1 << 30)
    assert iterate.shares(spark.read.parquet(f"{D}/lineitem.parquet")) == 0


def test_targets_read_pins_once(spark, monkeypatch):
    """One profile a type, and the targets that SQL has."""
    import duckdb

    from graphloom import queries
    from graphloom.plans import targets

    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    seen, profile = [], targets.profile
    monkeypatch.setattr(targets, "profile", lambda g, t: seen.append(t) or profile(g, t))
    for name in ("x3_targets", "x3_targets_completed"):
        want = sorted(con.execute(queries.ORACLE_SQL[name]).fetchall())
        assert rows(queries.QUERIES[name](spark, D)) == [(*r[:2], pytest.approx(r[2])) for r in want] and want
    assert seen == [0, 0]


def test_pairs_of_large_tables_are_dealt_to_more_tasks(spark, dealt):
    import duckdb

    from graphloom import queries
    from graphloom.plans import diffusive

    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    assert diffusive.shares(views.h1(spark, D).pins) > 8
    assert rows(queries.QUERIES["a17_connected_pairs"](spark, D)) == sorted(con.execute(queries.ORACLE_SQL["a17_connected_pairs"]).fetchall())


def test_choice_has_a_row_a_pin_and_stored_pairs(spark, monkeypatch):
    """A cavity's pins aren't given twice, and pairs are made before the kernel's rows."""
    from graphloom.graph import add_edge_type, construct_vertices
    from graphloom.plans import diffusive

    v = spark.createDataFrame([(i, int(i >= 2)) for i in range(4)], "gid long, part int")
    g = add_edge_type(construct_vertices(v, True, 2), spark.createDataFrame([(0, 1), (0, 2), (1, 0), (1, 1)], "eid long, gid long"))
    queue = spark.createDataFrame([(0, 0, 1)], "part int, eid long, rank int")
    seen, rows_of = [], diffusive._choice_rows

    def spied(*a):
        out = rows_of(*a)
        seen.append((hasattr(a[5], "_stored_at"), sorted((r["a"], r["b"], r["c"]) for r in out.where(f"kind = {diffusive.OWN}").collect()), out.where("kind > 1").count()))
        return out

    monkeypatch.setattr(diffusive, "_choice_rows", spied)
    diffusive.select(g, spark.createDataFrame([(0, 1, 1.0)], "part int, nbr int, target double"), queue, min_connectivity=2)
    assert [(s, n) for s, _, n in seen] == [(True, 3)] and (0, 1, 1) in seen[0][1] and (1, 0, None) not in seen[0][1]


def test_order_key_tells_pins_apart_once(spark, monkeypatch):
    from graphloom.plans import split

    seen, stored = [], split.stored
    monkeypatch.setattr(split, "stored", lambda df: seen.append(df.columns) or stored(df))
    split.order_key(views.h1(spark, D), 0)
    assert seen == [["eid", "gid"], *[["gid", "key"]] * 3]
