"""Writers of per-part binary graphs and of VTK files.

One task writes one part's file, as these formats have a file a part.  Binary graphs are streamed, a VTK part is held.
Files go through the file system that the path names, from the task that makes them."""

from __future__ import annotations

import os
import struct
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import NGraph
from ..schema import GraphError


def _local(path: str) -> str:
    """The plain path of a folder that all executors share, mounted as a local one."""
    if "://" in path and not path.startswith("file://"):
        raise GraphError("per-part files need a folder that is mounted on all executors")
    return path.removeprefix("file://")


def _each_part(rows: DataFrame, write, parts: int) -> int:
    """Run ``write(part, pandas)`` once for each part; the number of files."""

    def one(pdf):
        write(int(pdf["part"].iloc[0]), pdf)
        return pdf[["part"]].iloc[:1].assign(done=1)

    return rows.repartition(parts, "part").groupBy("part").applyInPandas(one, "part int, done int").count()


def write_bgd(g: NGraph, prefix: str) -> int:
    """[K1] Save as ``prefix_<part>.bgd``; the number of files.  Ids have 32 bits there, so
    others are refused; parent folders are made."""
    bad = g.vertices.where("gid < 0 or gid >= 4294967296").limit(1).count()
    bad += g.edges.where("eid < 0 or eid >= 4294967296").limit(1).count() if g.is_hyper else 0
    if bad:
        raise GraphError("ids from 0 to 2^32 - 1 can be saved only")
    kinds = {"etype": "int", "id": "long", "w": "double", "gids": "array<long>", "x": "double", "y": "double", "z": "double"}

    def rows(kind: int, df: DataFrame, **has: str) -> DataFrame:
        return df.select("part", F.lit(kind).alias("kind"), *((F.col(has[c]) if c in has else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))

    members = g.pins.groupBy("etype", "eid").agg(F.array_sort(F.collect_list(F.struct("pos", "gid"))).alias("p")).select("etype", "eid", F.transform("p", lambda x: x["gid"]).alias("gids"))
    copies = g.edge_copy().join(members, ["etype", "eid"], "left").withColumn("gids", F.coalesce("gids", F.array().cast("array<long>")))
    every = [
        rows(_PART, g.parts()),
        rows(_VERTEX, g.vertices, id="gid", w="w", x="x"),
        rows(_COORDS, g.vertices, id="gid", x="x", y="y", z="z"),
        rows(_EDGE, copies, etype="etype", id="eid", w="w", gids="gids"),
        rows(_GHOST, g.ghosts(), id="gid", w="owner"),
    ]
    hyper, types, target = g.is_hyper, g.num_types, _local(prefix)

    def write(batches):
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        out, done = None, 0
        for batch in batches:
            key = np.stack([batch["part"].to_numpy(), batch["kind"].to_numpy(), pc.fill_null(batch["etype"], 0).to_numpy()])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), key.shape[1]]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                part, kind, etype = key[:, i].tolist()
                if out is None or out.part != part:
                    done += out is not None and out.end()
                    out = _BgdFile(target, part, hyper, types)
                out.take(kind, etype, batch.slice(i, j - i))
        done += out is not None and out.end()
        yield pa.RecordBatch.from_arrays([pa.array([int(done)], pa.int64())], names=["n"])

    one = reduce(DataFrame.unionByName, every).repartition(g.num_parts, "part").sortWithinPartitions("part", "kind", "etype", "id")
    return one.mapInArrow(write, "n long").agg(F.sum("n")).head()[0] or 0


_PART, _VERTEX, _COORDS, _EDGE, _GHOST = range(5)


class _BgdFile:
    """One part's file, written section by section as sorted rows come; counts are filled in afterwards."""

    def __init__(self, target: str, part: int, hyper: bool, types: int):
        self.part, self.hyper, self.types, self.path = part, hyper, types, f"{target}_{part}.bgd"
        self.file = open(f"{self.path}.tmp", "wb")
        self.file.write(struct.pack(">I", hyper))
        self.sections = [(_VERTEX, 0), (_COORDS, 0), *((_EDGE, t) for t in range(types)), (_GHOST, 0)]
        self.at, self.n, self.placed = -1, 0, 0
        self.next()

    def next(self) -> None:
        """Close the section and open the one after it."""
        if self.at >= 0:
            kind = self.sections[self.at][0]
            if kind == _COORDS:
                self.file.write(struct.pack(">I", self.types))
            else:
                self.file.seek(self.start)
                self.file.write(struct.pack(">I", self.n))
                self.file.seek(0, os.SEEK_END)
            if kind == _VERTEX:
                self.coords = self.n > 0 and self.placed == self.n
        self.at, self.n = self.at + 1, 0
        if self.at < len(self.sections):
            kind, etype = self.sections[self.at]
            if kind == _EDGE:
                self.file.write(struct.pack(">I", etype))
            self.start = self.file.tell()
            self.file.write(struct.pack(">I", self.coords if kind == _COORDS else 0))

    def take(self, kind: int, etype: int, rows) -> None:
        if kind == _PART:
            return
        while self.sections[self.at] != (kind, etype):
            self.next()
        number = lambda c: rows[c].to_numpy(zero_copy_only=False)
        if kind == _COORDS:
            if self.coords:
                self.file.write(np.stack([number(c) for c in "xyz"], axis=1).astype(">f8").tobytes())
        elif kind == _EDGE:
            gids = rows["gids"]
            ends, own = (gids.offsets.to_numpy() - gids.offsets[0].as_py()).tolist(), gids.flatten().to_numpy(zero_copy_only=False).astype(">u4").tobytes()
            out = []
            for n, (i, w) in enumerate(zip(rows["id"].to_pylist(), rows["w"].to_pylist(), strict=True)):
                out += [struct.pack(">IdI", i if self.hyper else self.n + n, w, ends[n + 1] - ends[n]), own[4 * ends[n] : 4 * ends[n + 1]]]
            self.file.write(b"".join(out))
        else:
            pairs = np.empty(len(rows), dtype=[("id", ">u4"), ("w", ">f8" if kind == _VERTEX else ">u4")])
            pairs["id"], pairs["w"] = number("id"), number("w")
            self.file.write(pairs.tobytes())
            self.placed += len(rows) - rows["x"].null_count if kind == _VERTEX else 0
        self.n += len(rows)

    def end(self) -> bool:
        while self.at < len(self.sections):
            self.next()
        self.file.close()
        os.replace(f"{self.path}.tmp", self.path)  # a task that runs again leaves one whole file
        return True


def edge_centroids(g: NGraph, etype: int | None = None) -> DataFrame:
    """[K2] (etype, eid, cx, cy, cz): the mean place of an edge's pins, ghosts included."""
    at = g.typed(g.pins, etype).join(g.vertices.select("gid", "x", "y", "z"), "gid")
    return at.groupBy("etype", "eid").agg(*(F.avg(c).alias(f"c{c}") for c in "xyz"))


def write_vtk(g: NGraph, prefix: str, tag: DataFrame | None = None) -> int:
    """[K2] ``prefix_<part>.vtu`` and ``prefix.pvtu``: vertices and, in hypergraphs, edge
    centroids as points, with Part, VorE (0 vertex, 1 + type edge) and Tag (gid, tag); lines from edges to
    their pins, or from source to target.  Missing coordinates are 0."""
    points = g.vertices if tag is None else g.vertices.join(tag.select("gid", "tag"), "gid", "left")
    points = points if tag is not None else points.withColumn("tag", F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    own = points.select("part", F.lit(0).alias("kind"), F.lit(-1).alias("etype"), F.col("gid").alias("id"), F.lit(None).cast("long").alias("to"), *(zero(c) for c in "xyz"), zero("tag"))
    pins = g.pin_owner()
    if g.is_hyper:
        mid = g.edge_copy().select("etype", "eid", "part").join(edge_centroids(g), ["etype", "eid"], "left")
        own = own.unionByName(mid.select("part", F.lit(1).alias("kind"), "etype", F.col("eid").alias("id"), F.lit(None).cast("long").alias("to"), *(F.coalesce(f"c{c}", F.lit(0.0)).alias(c) for c in "xyz"), F.lit(0.0).alias("tag")))
        lines = pins.select("part", "etype", F.col("eid").alias("id"), F.col("gid").alias("to"))
    else:
        ends = pins.where("pos = 0").select("etype", "eid", "part", F.col("gid").alias("id")).join(g.pins.where("pos = 1").select("etype", "eid", F.col("gid").alias("to")), ["etype", "eid"])
        far = ends.join(g.vertices.select(F.col("gid").alias("to"), F.col("part").alias("q")), "to")
        lines = far.where("part = q").select("part", "etype", "id", "to")
    lines = lines.select("part", F.lit(2).alias("kind"), "etype", "id", "to", *(F.lit(0.0).alias(c) for c in ("x", "y", "z", "tag")))
    target, hyper = _local(prefix), g.is_hyper

    def write(part, pdf):
        pdf = pdf.sort_values(["kind", "etype", "id", "to"])
        at, cells = pdf[pdf["kind"] < 2], pdf[pdf["kind"] == 2]
        place = {(k, t, i): n for n, (k, t, i) in enumerate(zip(at["kind"], at["etype"], at["id"], strict=True))}
        ends = [(place[1, t, i] if hyper else place[0, -1, i], place[0, -1, int(v)]) for t, i, v in zip(cells["etype"], cells["id"], cells["to"], strict=True)]

        def array(name, kind, values, n=1):
            size = f' NumberOfComponents="{n}"' if n > 1 else ""
            return f'<DataArray type="{kind}" Name="{name}"{size} format="ascii">\n{" ".join(map(str, values))}\n</DataArray>\n'

        body = [
            '<VTKFile type="UnstructuredGrid" version="0.1"><UnstructuredGrid>\n',
            f'<Piece NumberOfPoints="{len(at)}" NumberOfCells="{len(ends)}">\n<Points>\n',
            array("Points", "Float64", at[["x", "y", "z"]].to_numpy().ravel(), 3),
            "</Points>\n<Cells>\n", array("connectivity", "Int64", (i for e in ends for i in e)),
            array("offsets", "Int64", range(2, 2 * len(ends) + 1, 2)), array("types", "UInt8", [3] * len(ends)),
            "</Cells>\n<PointData>\n", array("Part", "Int32", [part] * len(at)), array("VorE", "Int32", at["etype"] + 1),
            array("Tag", "Float64", at["tag"]), "</PointData>\n</Piece></UnstructuredGrid></VTKFile>\n",
        ]
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        with open(f"{target}_{part}.vtu.tmp", "w") as f:
            f.write("".join(body))
        os.replace(f"{target}_{part}.vtu.tmp", f"{target}_{part}.vtu")

    done = _each_part(own.unionByName(lines), write, g.num_parts)
    pieces = "".join(f'<Piece Source="{os.path.basename(target)}_{p}.vtu"/>\n' for p in range(g.num_parts) if os.path.exists(f"{target}_{p}.vtu"))
    with open(f"{target}.pvtu", "w") as f:
        f.write('<VTKFile type="PUnstructuredGrid" version="0.1"><PUnstructuredGrid GhostLevel="0">\n<PPoints><PDataArray type="Float64" NumberOfComponents="3"/></PPoints>\n')
        f.write('<PPointData><PDataArray type="Int32" Name="Part"/><PDataArray type="Int32" Name="VorE"/><PDataArray type="Float64" Name="Tag"/></PPointData>\n' + pieces)
        f.write("</PUnstructuredGrid></VTKFile>\n")
    return done


def write_ebin(edges: DataFrame, path: str) -> int:
    """Edges (u, v) as one file of little-endian 32-bit pairs, streamed in order of (u, v); the number of edges."""
    count = 0
    with open(_local(path), "wb") as f:
        for r in edges.orderBy("u", "v").toLocalIterator():
            f.write(struct.pack("<ii", r["u"], r["v"]))
            count += 1
    return count
