"""Readers of binary and text graph formats, mesh incidences, and synthetic graphs."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import block_part, dof_weight
from ..graph import NGraph, add_edge_type, construct_vertices
from ..schema import GraphError


def read_ebin(spark: SparkSession, path: str) -> DataFrame:
    """[S6] (u, v) of a file of little-endian 32-bit pairs.  The file is split by its records."""
    rows = spark.sparkContext.binaryRecords(path, 8).map(lambda r: struct.unpack("<ii", bytes(r)))
    return spark.createDataFrame(rows, "u long, v long")


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """[S8] (gid, part) of a text: line i has the part of vertex i."""
    lines = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1], int(x[0][0])))
    return spark.createDataFrame(lines, "gid long, part int")


def ebin_graph(spark: SparkSession, path: str, num_parts: int, partition: str | None = None) -> NGraph:
    """[S6, S7, S9, S10] Directed graph of an edge file: vertices 0 to the largest id, also
    those without edges, owned by blocks or by a partition file; an edge's id is its place among its source's edges."""
    edges = read_ebin(spark, path)
    n = (edges.agg(F.max(F.greatest("u", "v"))).head()[0] if not edges.isEmpty() else -1) + 1
    ids = spark.range(n).withColumnRenamed("id", "gid")
    owned = ids.join(read_partition(spark, partition), "gid", "left").withColumn("part", F.coalesce("part", F.lit(0))) if partition else ids.withColumn("part", block_part(F.col("gid"), n, num_parts))
    numbered = edges.withColumn("eid", F.monotonically_increasing_id())
    return add_edge_type(construct_vertices(owned, False, num_parts), numbered.select("eid", F.posexplode(F.array("u", "v")).alias("pos", "gid")))


def read_coords(spark: SparkSession, path: str) -> DataFrame:
    """[S16] (gid, x, y, z) of a text: line i has the coordinates of vertex i."""
    lines = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1], *map(float, x[0][0].split()[:3])))
    return spark.createDataFrame(lines, "gid long, x double, y double, z double")


# -- per-part binary graphs -----------------------------------------------------------
# u32 and f64, big-endian.  u32 hyper; u32 vertices, each u32 gid, f64 w; u32
# has coordinates, each 3 f64; u32 types; by type u32 type, u32 edges, each u32 eid, f64 w,
# u32 degree, degree times u32 gid; u32 ghosts, each u32 gid, u32 owner.

_BLOCK = 1 << 14
_ROW = "kind string, part int, etype int, id long, w double, gids array<long>, x double, y double, z double"


def parse_bgd(part: int, file: BinaryIO) -> Iterator[tuple]:
    """Rows (kind, part, etype, id, w, gids, x, y, z) of one part's file, as they are read."""

    def take(form: str):
        return struct.unpack(">" + form, file.read(struct.calcsize(">" + form)))

    hyper, n = take("II")
    yield ("graph", part, None, hyper, None, None, None, None, None)
    # vertices and their places, in two sections, are read side by side
    first = file.tell()
    file.seek(first + 12 * n)
    coords = take("I")[0]
    second = file.tell()
    for i in range(0, n, _BLOCK):
        m = min(_BLOCK, n - i)
        file.seek(first + 12 * i)
        own = list(struct.iter_unpack(">Id", file.read(12 * m)))
        file.seek(second + 24 * i)
        places = struct.iter_unpack(">ddd", file.read(24 * m)) if coords else [(None, None, None)] * m
        for (gid, w), xyz in zip(own, places, strict=True):
            yield ("vertex", part, None, gid, w, None, *xyz)
    file.seek(second + (24 * n if coords else 0))
    for _ in range(take("I")[0]):
        t, edges = take("II")
        yield ("type", part, t, None, None, None, None, None, None)
        for _ in range(edges):
            eid, w, degree = take("IdI")
            yield ("edge", part, t, eid, w, np.frombuffer(file.read(4 * degree), ">u4").astype("int64"), None, None, None)
    for _ in range(take("I")[0]):
        gid, owner = take("II")
        yield ("ghost", part, None, gid, float(owner), None, None, None, None)


def _batches(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Lists of 10,000 rows, or of so many that their edges have 500,000 pins."""
    out, pins = [], 0
    for r in rows:
        out.append(r)
        pins += 0 if r[5] is None else len(r[5])
        if len(out) == 10_000 or pins >= 500_000:
            yield out
            out, pins = [], 0
    if out:
        yield out


def read_bgd(spark: SparkSession, prefix: str) -> NGraph:
    """[S11] A graph saved as ``prefix_<part>.bgd``, one task a file.  Files in a mounted folder are
    streamed; of others a task has the bytes of one."""
    mounted = "://" not in prefix or prefix.startswith("file://")
    content = F.lit(None).cast("binary").alias("content") if mounted else F.col("content")
    files = spark.read.format("binaryFile").load(f"{prefix}_*.bgd").select(F.regexp_extract("path", r"_(\d+)\.bgd$", 1).cast("int").alias("part"), content)
    local = prefix.removeprefix("file://")

    def parse(batches):
        import pyarrow as pa

        names = ["kind", "part", "etype", "id", "w", "gids", "x", "y", "z"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int64()), *[pa.float64()] * 3]
        for batch in batches:
            for part, raw in zip(batch["part"].to_pylist(), batch["content"].to_pylist(), strict=True):
                with open(f"{local}_{part}.bgd", "rb") if mounted else io.BytesIO(raw) as file:
                    for rows in _batches(parse_bgd(part, file)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows = files.mapInArrow(parse, _ROW)
    head = rows.where("kind in ('graph', 'type')").groupBy("kind").agg(F.max("id").alias("hyper"), F.max("etype").alias("t"), F.countDistinct("part").alias("parts"), F.max("part").alias("last")).collect()
    info = {r["kind"]: r for r in head}
    if "graph" not in info:
        raise GraphError(f"no files {prefix}_<part>.bgd")
    vertices = rows.where("kind = 'vertex'").select(F.col("id").alias("gid"), "w", "part", "x", "y", "z")
    g = construct_vertices(vertices, bool(info["graph"]["hyper"]), info["graph"]["last"] + 1)
    # a hyperedge is in the file of every part that has a copy
    edges = rows.where("kind = 'edge'").select("etype", "id", "w", "part", "gids")
    if not g.is_hyper:
        # ids without hyperedges need only be unique in their file
        edges = edges.withColumn("id", F.col("part").cast("long") * (1 << 32) + F.col("id"))
    for t in range(info["type"]["t"] + 1 if "type" in info else 0):
        mine = edges.where(F.col("etype") == t)
        one = mine.groupBy(F.col("id").alias("eid")).agg(F.first("w").alias("w"), F.min("part").alias("home_part"), F.first("gids").alias("gids"))
        pins = one.select("eid", F.posexplode("gids").alias("pos", "gid"))
        g = add_edge_type(g, pins.select("eid", "gid") if g.is_hyper else pins, one.select("eid", "w", "home_part"))
    return g


# -- meshes ----------------------------------------------------------------------------


def mesh_graph(entities: DataFrame, incidence: DataFrame, primary: int, secondary: list[int], num_parts: int, mesh_dim: int = 3) -> NGraph:
    """[S12] Hypergraph of a mesh: entities (dim, id, part[, x, y, z]) of the dimension
    ``primary`` are vertices, each dimension in ``secondary`` gives a type of hyperedges.
    ``incidence``: (dim_a, id_a, dim_b, id_b), in either direction."""
    if not 0 <= primary <= mesh_dim:
        raise GraphError(f"1: the primary dimension {primary} is not in 0..{mesh_dim}")
    for d in secondary:
        if not 0 <= d <= mesh_dim:
            raise GraphError(f"2: the secondary dimension {d} is not in 0..{mesh_dim}")
        if d == primary:
            raise GraphError("3: a dimension can't be both primary and secondary")
    own = entities.where(F.col("dim") == primary).withColumnRenamed("id", "gid").drop("dim")
    g = construct_vertices(own, True, num_parts)
    both = incidence.select("dim_a", "id_a", "dim_b", "id_b").union(incidence.select("dim_b", "id_b", "dim_a", "id_a"))
    for d in secondary:
        pins = both.where((F.col("dim_a") == d) & (F.col("dim_b") == primary)).select(F.col("id_a").alias("eid"), F.col("id_b").alias("gid"))
        g = add_edge_type(g, pins, entities.where(F.col("dim") == d).select(F.col("id").alias("eid"), F.col("part").alias("home_part")))
    return g


def dof_graph(entities: DataFrame, incidence: DataFrame, order: int, num_parts: int) -> NGraph:
    """[S13] Elements (dim 3) as vertices; all entities of dims 0 to 2 that hold degrees of
    freedom as one type of hyperedges, weighted by their number, ids offset by dimension."""
    top = {r["dim"]: r["n"] for r in entities.where("dim < 3").groupBy("dim").agg((F.max("id") + 1).alias("n")).collect()}
    offset = F.when(F.col("dim") == 0, 0).when(F.col("dim") == 1, top.get(0, 0)).otherwise(top.get(0, 0) + top.get(1, 0)).cast("long")
    holders = entities.where("dim < 3").withColumn("w", dof_weight(F.col("dim"), order)).where("w is not null").select("dim", "id", "w", (offset + F.col("id")).alias("eid"), F.col("part").alias("home_part"))
    g = construct_vertices(entities.where("dim = 3").withColumnRenamed("id", "gid").drop("dim"), True, num_parts)
    both = incidence.select("dim_a", "id_a", "dim_b", "id_b").union(incidence.select("dim_b", "id_b", "dim_a", "id_a"))
    pins = both.where("dim_b = 3").join(holders.select(F.col("dim").alias("dim_a"), F.col("id").alias("id_a"), "eid"), ["dim_a", "id_a"]).select("eid", F.col("id_b").alias("gid"))
    return add_edge_type(g, pins, holders.select("eid", "w", "home_part"))


def number_rows(df: DataFrame, name: str, *order: str) -> DataFrame:
    """[S16] ``df`` with a place from 0 within each part, for formats that need local ids."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
