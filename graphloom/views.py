"""Graphs over the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import block_part
from .graph import NGraph, add_edge_type, construct_graph, construct_vertices

PARTS = 4


def skewed_part(gid: Column, n: int) -> Column:
    """Four parts that own 40, 30, 20 and 10 % of ``n`` vertices."""
    return F.when(gid * 10 < 4 * n, 0).when(gid * 10 < 7 * n, 1).when(gid * 10 < 9 * n, 2).otherwise(3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def h1(spark: SparkSession, sf_dir: str, parts: int = PARTS, skewed: bool = False) -> NGraph:
    """Parts as vertices; orders (type 0) and suppliers (type 1) as hyperedges.
    ``skewed``: owned 40, 30, 20 and 10 % by four parts."""
    part = table(spark, sf_dir, "part")
    n = part.count()
    gid = F.col("p_partkey")
    owner = skewed_part(gid, n) if skewed else block_part(gid, n, parts)
    vertices = part.select(gid.alias("gid"), owner.alias("part"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"), F.lit(0.0).alias("z"))
    items = table(spark, sf_dir, "lineitem")
    return construct_graph(vertices, [items.select(F.col(c).alias("eid"), F.col("l_partkey").alias("gid")) for c in ("l_orderkey", "l_suppkey")], True, parts)


def h2(spark: SparkSession, sf_dir: str, parts: int = PARTS, skewed: bool = False) -> NGraph:
    """Orders as vertices with their price; customers (type 0) and parts (type 1) as hyperedges.
    ``skewed``: as in h1."""
    orders = table(spark, sf_dir, "orders")
    n = orders.count()
    gid = F.col("o_orderkey")
    owner = skewed_part(gid, n) if skewed else block_part(gid, n, parts)
    vertices = orders.select(gid.alias("gid"), F.col("o_totalprice").alias("w"), owner.alias("part"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("eid"), F.col("l_orderkey").alias("gid"))
    return construct_graph(vertices, [orders.select(F.col("o_custkey").alias("eid"), F.col("o_orderkey").alias("gid")), items], True, parts)


def t1(spark: SparkSession, sf_dir: str, parts: int = PARTS) -> NGraph:
    """Users as vertices; type t: hand-offs from one event of the t-th kind to the next one."""
    events = table(spark, sf_dir, "events")
    users = events.select(F.col("user_id").alias("gid")).distinct()
    n = users.agg(F.max("gid")).head()[0] + 1
    g = construct_vertices(users.withColumn("part", block_part(F.col("gid"), n, parts)), False, parts)
    # a window a kind and hour; an hour's last event goes on to the first of the kind's next hour,
    # which a table of a row a kind and hour tells
    key = ["event_type", "hour"]
    rows = events.select("event_type", F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", "user_id")
    first = rows.groupBy(*key).agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    after = first.select(*key, F.lead("first").over(Window.partitionBy("event_type").orderBy("hour")).alias("next"))
    here = Window.partitionBy(*key).orderBy("ts", "event_id")
    moves = rows.withColumn("then", F.lead(F.struct("user_id")).over(here)).join(after, key)
    moves = moves.select("event_type", F.col("event_id").alias("eid"), F.col("user_id").alias("u"), F.when(F.col("then").isNull(), F.col("next")).otherwise(F.col("then.user_id")).alias("v")).where("v is not null")
    for kind in sorted(r[0] for r in events.select("event_type").distinct().collect()):
        own = moves.where(F.col("event_type") == kind)
        g = add_edge_type(g, own.select("eid", F.posexplode(F.array("u", "v")).alias("pos", "gid")))
    return g
