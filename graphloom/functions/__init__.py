"""Column expressions and small table functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def block_part(gid: Column, vertices: int, parts: int) -> Column:
    """[S7] Owner of a vertex when ids 0 .. ``vertices`` - 1 are dealt in equal blocks."""
    return F.floor(gid / F.lit(vertices // parts + 1)).cast("int")


def dof_weight(dim: Column, order: int) -> Column:
    """[S13] Degrees of freedom that an entity of ``dim`` holds at a polynomial order; null: none."""
    w = F.when(dim == 0, F.lit(1.0))
    if order >= 2:
        w = w.when(dim == 1, F.lit(float(order - 1)))
    if order >= 4:
        w = w.when(dim == 2, F.lit(float(order - 3)))
    return w


def exclusive_scan(rows: DataFrame, part: str, value: str) -> DataFrame:
    """[A16] (part, value, scan): the sum over all smaller parts.  One row a part: one task is enough."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(part, value, F.coalesce(F.sum(value).over(before), F.lit(0)).alias("scan"))


def part_reduce(rows: DataFrame, value: str) -> DataFrame:
    """[A15] Sum, least and greatest, and logical and and or of a value over parts, in one row."""
    return rows.agg(
        F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.bool_or(F.col(value) != 0).alias("any"), F.bool_and(F.col(value) != 0).alias("all"),
    )
