"""Shared plumbing: work tables in the shared folder, Arrow helpers, tree sums."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..iterate import release, stored, work_dir

__all__ = ["batch_of", "by_batch", "column", "flat", "long_key", "map_arrow", "release", "slices", "stored", "table", "text_key", "tree_sum", "work_dir"]

#: Bytes of text that one vectorised step works on, which takes some 50 times as many; bounds a Python worker's memory.
SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch to a Python worker.  Spark fills 64 MB, which a task's two ends hold some times over.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches of ``BATCH_BYTES`` or so.  This limit is the session's, as Spark reads it when the
    plan runs, and stays set; a lower one is left alone."""
    spark = df.sparkSession
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """map_arrow() with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return map_arrow(df, run, schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes in ``column`` each; a longer text stands alone."""
    if batch.num_rows == 0:
        return
    _, offs = flat(batch.column(batch.schema.get_field_index(column)))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offs, offs[begin] + limit, "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets of its texts; null reads as empty."""
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    if not pa.types.is_large_string(array.type) and not pa.types.is_large_binary(array.type):
        array = array.cast(pa.large_binary() if pa.types.is_binary(array.type) else pa.large_string())
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def tree_sum(df: DataFrame, keys: list[str], blob: str, dtype: str) -> DataFrame:
    """Sum equally long number arrays kept as bytes, by ``keys``.  Two levels: each
    task adds about the square root of the number of partial arrays at most."""
    fan = max(2, math.isqrt(max(4, df.rdd.getNumPartitions())))
    of = {f.name: f for f in df.schema}
    names = [*keys, "__shard"]
    schema = ", ".join(f"`{k}` {of[k].dataType.simpleString()}" for k in keys) + f", __shard int, `{blob}` binary"

    def add(pdf):
        total = None
        for raw in pdf[blob]:
            part = np.frombuffer(raw, dtype)
            total = part.copy() if total is None else total + part
        return pdf.iloc[:1][names].assign(**{blob: [total.tobytes()]})

    first = df.select(*keys, (F.spark_partition_id() % fan).cast("int").alias("__shard"), blob)
    out = first.groupBy(*names).applyInPandas(add, schema)
    out = out.withColumn("__shard", F.lit(0)).groupBy(*names).applyInPandas(add, schema)
    return out.drop("__shard")


def long_key(name: str = "doc_id"):
    """Document ids for joins and order: null counts as the largest id."""
    return F.coalesce(F.col(name).cast("long"), F.lit((1 << 63) - 1))


def text_key(name: str = "text"):
    """128 bits that stand for a text; null and empty are the same."""
    return F.unhex(F.md5(F.coalesce(F.col(name), F.lit(""))))
