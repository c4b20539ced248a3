"""[X29] Invariants of a graph, each as the number of rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import NGraph


def validity(g: NGraph) -> DataFrame:
    """(check_name, violations), one row for each invariant; all are 0 for a valid graph."""
    pins, edges, vertices = g.pins, g.edges, g.vertices

    def broken(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")

    key = ["etype", "eid"]
    checks = [
        broken("vertex_key", vertices.groupBy("gid").count().where("count > 1 or gid is null")),
        broken("edge_key", edges.groupBy(*key).count().where("count > 1 or eid is null")),
        broken("pin_vertex", pins.join(vertices.select("gid"), "gid", "left_anti")),
        broken("pin_edge", pins.join(edges, key, "left_anti")),
        broken("owner_range", vertices.where(f"part is null or part < 0 or part >= {g.num_parts}")),
        broken("vertex_weight", vertices.where("w is null or isnan(w)")),
        broken("edge_weight", edges.where("w is null or isnan(w)")),
        broken("edge_type", edges.where(f"etype < 0 or etype >= {g.num_types}")),
    ]
    if g.is_hyper:
        checks.append(broken("pin_key", pins.groupBy(*key, "gid").count().where("count > 1")))
    else:
        two = pins.groupBy(*key).agg(F.array_sort(F.collect_list("pos")).alias("pos"))
        checks.append(broken("two_ends", edges.join(two, key, "left").where("pos is null or pos <> array(0, 1)")))
    ghosts = g.ghosts()
    checks.append(broken("ghost_owner", ghosts.where(f"owner = part or owner < 0 or owner >= {g.num_parts}")))
    return reduce(DataFrame.unionByName, checks)
