"""Work tables for iterative operators: written to the folder all executors share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of the files that one task's share of a table comes from.
SHARE = 8 << 20


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own if all of Spark is one
    process.  On a cluster executors don't see each other's folders, so it must be set there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/graphloom-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shares(df: DataFrame) -> int:
    """Partitions to deal ``df`` to, so that a task's share doesn't grow with the files it is read from; 0 if
    Spark's own choice does.  That is as few as there are cores, or of 64 packed MB, which are millions of pins."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size())]
    # tables of unknown size claim 8 EB
    n = math.ceil(sum(x for x in sizes if x < 1 << 60) / SHARE)
    # fewer than Spark's would be dealt again by a join
    return 0 if n <= spark.sparkContext.defaultParallelism else max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, n: int, *by: str) -> DataFrame:
    """``df`` dealt to ``n`` partitions; as it is for 0."""
    return df.repartition(n, *by) if n else df


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it again: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete a work table that nothing reads any more; other tables stay."""
    path = getattr(df, "_stored_at", None)
    if path:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
