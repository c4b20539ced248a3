"""The canonical tables of a graph, its limits and its errors."""

from __future__ import annotations

from pyspark.sql import types as T

#: Edge types are 0 .. MAX_TYPES - 1; the last one links copies of cut vertices.
NO_TYPE, VTX_TYPE, MAX_TYPES = -2, -1, 7
SPLIT_TYPE = MAX_TYPES - 1

VERTICES = T.StructType(
    [T.StructField("gid", T.LongType()), T.StructField("w", T.DoubleType()), T.StructField("part", T.IntegerType()), T.StructField("orig_part", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in "xyz"]
)
EDGES = T.StructType([T.StructField("etype", T.IntegerType()), T.StructField("eid", T.LongType()), T.StructField("w", T.DoubleType()), T.StructField("home_part", T.IntegerType())])
PINS = T.StructType([T.StructField("etype", T.IntegerType()), T.StructField("eid", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("gid", T.LongType())])


class GraphError(ValueError):
    """A graph or an argument that breaks the model's rules."""


def check_etype(etype: int, num_types: int | None = None) -> int:
    if not 0 <= etype < (MAX_TYPES if num_types is None else num_types):
        raise GraphError(f"edge type {etype} is not in 0..{(num_types or MAX_TYPES) - 1}")
    return etype
