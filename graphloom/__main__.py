"""[B6] python -m graphloom balance|split IN OUT: graphs saved by part, read, balanced or split, and saved."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .operators import metrics
from .plans import DiffusiveInput, SplitInput, diffusive, split
from .sinks import write_bgd
from .sources import read_bgd
from .timers import Timers


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    args.add_argument("action", choices=("balance", "split", "evaluate"))
    args.add_argument("source", help="prefix of the saved graph")
    args.add_argument("target", nargs="?", help="prefix to save the result with")
    args.add_argument("--tolerance", type=float, default=1.1)
    args.add_argument("--step", type=float, default=0.1)
    args.add_argument("--edge-type", type=int, action="append", default=[], help="balanced before the vertices, in this order")
    args.add_argument("--parts", type=int, default=2, help="of each part, for split")
    args.add_argument("--part-weights", action="store_true", help="targets from the part-weight balancer")
    args.add_argument("-v", "--verbose", action="store_true")
    given = args.parse_args(argv)
    logging.basicConfig(level=logging.INFO if given.verbose else logging.WARNING)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    g, timers = read_bgd(spark, given.source), Timers()
    if given.action == "balance":
        priorities = tuple((t, given.tolerance) for t in (*given.edge_type, -1))
        g = diffusive.balance(g, DiffusiveInput(priorities, step_factor=given.step, part_weight_balancer=given.part_weights), timers)
    elif given.action == "split":
        g = split.split_local(g, given.parts, SplitInput(tolerance=given.tolerance))
    metrics.evaluate_partition(g).orderBy("metric", "etype").show(truncate=False)
    for name, seconds, calls, each in timers.rows():
        print(f"{name}: {seconds:.2f} s in {calls} calls, {each:.2f} s each")
    if given.target:
        write_bgd(g, given.target)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
