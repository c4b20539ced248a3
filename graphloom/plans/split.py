"""Splitting a graph into more parts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import NGraph
from ..iterate import release, stored
from ..operators.access import set_original_owners
from . import DiffusiveInput, SplitInput
from .diffusive import balance

#: Buckets of the curve that weights are summed over before it is cut into parts.
CURVE_BUCKETS = 1 << 16


def order_key(g: NGraph, etype: int) -> DataFrame:
    """(gid, key): a place on a line that keeps neighbours close: the middle of a vertex's
    edges' middles, smoothed three times from its id."""
    now = _scaled(g.vertices)
    # told apart once, not twice a step
    pins = stored(g.typed(g.pins, etype).select("eid", "gid"))
    for _ in range(3):
        mid = pins.join(now, "gid").groupBy("eid").agg(F.avg("key").alias("mid"))
        near = pins.join(mid, "eid").groupBy("gid").agg(F.avg("mid").alias("near"))
        old, now = now, stored(now.join(near, "gid", "left").select("gid", ((F.col("key") + F.coalesce("near", "key")) / 2).alias("key")))
        release(old)
    release(pins)
    return now


def _scaled(vertices: DataFrame) -> DataFrame:
    r = vertices.agg(F.min("gid").alias("low"), F.max("gid").alias("high")).head()
    low, width = r["low"] or 0, max(1, (r["high"] or 0) - (r["low"] or 0))
    return vertices.select("gid", ((F.col("gid") - low) / width).alias("key"))


def kway(g: NGraph, parts: int, given: SplitInput = SplitInput()) -> DataFrame:
    """[X24, X26] (gid, part): ``parts`` parts of about equal weight.

    Vertices are put on a line; the line is cut where running weights pass the parts' shares.
    The driver sees a fixed number of sums, and each vertex its place among those of its bucket by
    a window."""
    keyed = order_key(g, given.edge_type).join(g.vertices.select("gid", "w"), "gid")
    r = keyed.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.sum("w").alias("total")).head()
    low, width, total = r["low"] or 0.0, max(1e-12, (r["high"] or 0) - (r["low"] or 0)), r["total"] or 1.0
    bucket = F.least(F.floor((F.col("key") - low) / width * CURVE_BUCKETS), F.lit(CURVE_BUCKETS - 1)).cast("int")
    dealt = stored(keyed.withColumn("bucket", bucket))
    sums = np.zeros(CURVE_BUCKETS)
    for x in dealt.groupBy("bucket").agg(F.sum("w").alias("w")).collect():
        sums[x["bucket"]] = x["w"]
    before = np.concatenate(([0.0], np.cumsum(sums)[:-1]))
    start = F.broadcast(g.spark.createDataFrame(pd.DataFrame({"bucket": np.flatnonzero(sums > 0).astype("int32"), "before": before[sums > 0]})))
    inside = F.sum("w").over(Window.partitionBy("bucket").orderBy("key", "gid"))
    at = dealt.withColumn("at", inside - F.col("w") / 2).join(start, "bucket")
    return at.select("gid", F.least(F.floor((F.col("before") + F.col("at")) / total * parts), F.lit(parts - 1)).cast("int").alias("part"))


def split(g: NGraph, new_parts: int, given: SplitInput = SplitInput(), refine: bool = True) -> NGraph:
    """[X23, X24] Split all of the graph into ``new_parts``; owners of before are the original ones."""
    g = set_original_owners(g)
    labels = kway(g, new_parts, given)
    out = g.vertices.drop("part").join(labels, "gid").select(g.vertices.columns)
    g = g.with_(vertices=stored(out), num_parts=new_parts)
    return balance(g, DiffusiveInput(((-1, given.tolerance),), max_iterations_per_type=20)) if refine else g


def split_local(g: NGraph, factor: int, given: SplitInput = SplitInput(), other_parts: dict[tuple[int, int], int] | None = None) -> NGraph:
    """[X25] Split every part by itself into ``factor`` parts: part * factor + i, or by
    ``other_parts`` (part, i) -> new part."""
    g = set_original_owners(g)
    keyed = order_key(g, given.edge_type).join(g.vertices.select("gid", "w", "part"), "gid")
    run = Window.partitionBy("part").orderBy("key", "gid")
    share = (F.sum("w").over(run) - F.col("w") / 2) / F.sum("w").over(Window.partitionBy("part"))
    piece = F.least(F.floor(share * factor), F.lit(factor - 1)).cast("int")
    labels = keyed.select("gid", F.col("part").alias("old"), piece.alias("piece"))
    if other_parts is None:
        labels = labels.select("gid", (F.col("old") * factor + F.col("piece")).cast("int").alias("part"))
        parts = g.num_parts * factor
    else:
        names = g.spark.createDataFrame([(p, i, n) for (p, i), n in other_parts.items()], "old int, piece int, part int")
        labels, parts = labels.join(F.broadcast(names), ["old", "piece"]).select("gid", "part"), max(other_parts.values()) + 1
    out = g.vertices.drop("part").join(labels, "gid").select(g.vertices.columns)
    return g.with_(vertices=stored(out), num_parts=parts)
