"""Line dedup by a suffix array over line ids.

A corpus is the sequence of its documents' lines; a suffix is what follows a line in its
own document.  Prefix doubling ranks all suffixes by their first 1, 2, 4, ... lines: a
suffix's rank for 2h lines comes from its rank for h lines and that of the suffix h lines
on.  Ranks are places in the suffix array, so a class of equal ranks is an interval of it;
a class for h lines is an LCP interval: all its suffixes share h lines or more.  Suffixes that
are alone in their class, or that end within h lines, are final; each round takes only
documents with suffixes that aren't, until there are none.

In every interval of ``min_lines`` lines or more the first suffix stays and all others
are later copies, whose shared lines are deleted.  A single line is a run too if it has
``long_words`` words or more, where that is given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_batch, column, flat, long_key, release, slices, stored, text_key
from .textops import span_hashes, word_spans

MIN_LINES = 2
#: Words of a line that is a run alone, for those who ask for that.
LONG_WORDS = 50


def _lines(batch, long_words: int | None = None):
    for part in slices(batch, "text"):
        data, offs = flat(column(part, "text"))
        some = offs[1:] > offs[:-1]
        breaks = np.flatnonzero(data == 10)
        inner = np.searchsorted(offs, breaks, "right") - 1
        doc = np.concatenate((np.flatnonzero(some), inner))
        start = np.concatenate((offs[:-1][some], breaks + 1))
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        end = np.concatenate((start[1:] - 1, offs[-1:])) if len(start) else start
        final = np.flatnonzero(np.concatenate((doc[1:] != doc[:-1], [True]))) if len(doc) else []
        if len(doc):
            end[final] = offs[doc[final] + 1]
        pos = np.arange(len(doc)) - np.searchsorted(doc, doc, "left")
        ids = span_hashes(data, start, end)
        long = np.zeros(len(doc), bool)
        if long_words is not None:
            words = word_spans(data, offs)[0]
            long = np.searchsorted(words, end) - np.searchsorted(words, start) >= long_words
        yield pa.RecordBatch.from_arrays([column(part, "did").take(pa.array(doc)), column(part, "tk").take(pa.array(doc)), pa.array(pos.astype(np.int32)), pa.array(ids.view(np.int64)), pa.array(long)], names=["did", "tk", "pos", "line", "long"])


def running_sums(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``df`` with ``before``, the sum of ``weight`` over all rows with smaller ``keys``.

    A range shuffle sorts the rows; each task sums its own, and the driver adds up one number
    a partition.  No window over all rows."""
    names = df.columns
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def add(batches):
        from pyspark import TaskContext

        task, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            w = column(batch, weight).to_numpy().astype(np.int64)
            sums = total + np.cumsum(w)
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums - w), pa.array(np.full(len(w), task, np.int32))], names=[*names, "before", "task"])

    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    part = stored(dealt.mapInArrow(add, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", before long, task int"))
    total, offsets = 0, []
    for r in part.groupBy("task").agg(F.max(F.col("before") + F.col(weight)).alias("s")).orderBy("task").collect():
        offsets.append((r["task"], total))
        total += r["s"]
    spark = df.sparkSession
    # as many rows as the shuffle has partitions
    shift = F.broadcast(spark.createDataFrame(offsets, "task int, shift long"))
    return part.join(shift, "task").select(*names, (F.col("before") + F.col("shift")).alias("before"))


def intervals(docs: DataFrame, long_words: int | None = None):
    """Rounds of prefix doubling.  Yields (h, table (did, tk, pos, left, rank, open, later)):
    the suffixes of documents that had open ones, by their ranks for h lines; ``left``: lines
    from there to the document's end; ``open``: others share the h lines and there may be
    more; ``later``: an earlier suffix shares the h lines, or all that is left.  The first
    table also has ``long``: the line has ``long_words`` words or more."""
    rows = docs.select(long_key().alias("did"), text_key().alias("tk"), "text")
    whole = Window.partitionBy("did", "tk")
    lines = by_batch(rows, lambda b: _lines(b, long_words), "did long, tk binary, pos int, line long, long boolean")
    # rows that repeat another wholly are one document
    lines = stored(lines.repartition("did", "tk").groupBy("did", "tk", "pos").agg(F.first("line").alias("line"), F.first("long").alias("long")).withColumn("left", F.count("*").over(whole) - F.col("pos")))
    place = F.struct("did", "tk", "pos")
    seen = lines.groupBy("line").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    ranks = running_sums(seen, ["line"], "n")
    now = lines.join(ranks.select("line", F.col("before").alias("rank"), "n", "first"), "line")
    now = now.select("did", "tk", "pos", "left", "rank", "long", (F.col("n") > 1).alias("open"), ((F.col("n") > 1) & (place != F.col("first"))).alias("later"))
    now = stored(now)
    release(lines)
    h = 1
    while True:
        yield h, now
        ahead = Window.partitionBy("did", "tk").orderBy("pos")
        pairs = now.select("did", "tk", "pos", "left", "rank", "open", F.coalesce(F.lead("rank", h).over(ahead), F.lit(-1)).alias("next"), F.max("open").over(whole).alias("active"))
        pairs = stored(pairs.where("active").drop("active"))
        if pairs.where("open").isEmpty():
            release(pairs)
            return
        seen = pairs.where("open").groupBy("rank", "next").agg(F.count("*").alias("n"), F.min(place).alias("first"))
        sums = running_sums(seen, ["rank", "next"], "n")
        base = sums.groupBy("rank").agg(F.min("before").alias("base"))
        named = sums.join(base, "rank").select("rank", "next", "n", "first", (F.col("rank") + F.col("before") - F.col("base")).alias("new"))
        moved = pairs.where("open").join(named, ["rank", "next"])
        shared = F.col("n") > 1
        moved = moved.select("did", "tk", "pos", "left", F.col("new").alias("rank"), (shared & (F.col("next") >= 0)).alias("open"), (shared & (place != F.col("first"))).alias("later"))
        rest = pairs.where("not open").select("did", "tk", "pos", "left", "rank", F.lit(False).alias("open"), F.lit(False).alias("later"))
        new = stored(moved.unionByName(rest))
        release(pairs)
        now, h = new, 2 * h


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """(did, tk, marks array<struct<pos, size>>): by document, where ``size`` lines from line
    ``pos`` on are a later copy.  Lines of ``long_words`` words or more are runs alone.

    An interval for h lines serves all ``min_lines`` up to h; the smallest h does for the
    lines to delete, larger ones tell the runs' lengths.  For other numbers than powers of two
    the last interval below is cut by the suffix min_lines - h lines on, as the two overlap."""
    marks, last = None, None
    for h, table in intervals(docs, long_words):
        if h == 1 and long_words is not None and min_lines > 1:
            marks = stored(table.where("later and long").select("did", "tk", "pos", F.lit(1).alias("size")))
        if h >= min_lines:
            own = table.where("later").select("did", "tk", "pos", F.least(F.lit(h), "left").cast("int").alias("size")).where(F.col("size") >= min_lines)
        elif 2 * h > min_lines:
            step = min_lines - h
            ahead = Window.partitionBy("did", "tk").orderBy("pos")
            cut = table.withColumn("next", F.coalesce(F.lead("rank", step).over(ahead), F.lit(-1)))
            cut = cut.where(F.col("open") & (F.col("left") >= min_lines))
            seen = cut.groupBy("rank", "next").agg(F.min(F.struct("did", "tk", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
            own = cut.join(seen, ["rank", "next"]).where(F.struct("did", "tk", "pos") != F.col("first")).select("did", "tk", "pos", F.lit(min_lines).alias("size"))
        else:
            own = None
        if own is not None:
            part = stored(own)
            marks = part if marks is None else marks.unionByName(part)
        if last is not None:
            release(last)
        last = table
    if marks is None:  # no two suffixes share so much as half of min_lines
        empty = "did long, tk binary, marks array<struct<pos:int,size:int>>"
        return docs.sparkSession.createDataFrame([], empty)
    release(last)
    # of one place the longest shared run
    longest = marks.groupBy("did", "tk", "pos").agg(F.max("size").alias("size"))
    return stored(longest.groupBy("did", "tk").agg(F.collect_list(F.struct("pos", "size")).alias("marks")))


def _delete(batch, names):
    for part in slices(batch, "text"):
        texts, totals, gone, longest = [], [], [], []
        for text, marks in zip(column(part, "text").to_pylist(), column(part, "marks").to_pylist(), strict=True):
            n = text.count("\n") + 1 if text else 0
            totals.append(n)
            dropped = run = 0
            if marks:
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, [m["pos"] for m in marks], 1)
                np.add.at(step, [m["pos"] + m["size"] for m in marks], -1)
                keep = np.cumsum(step[:n]) == 0
                dropped = n - int(keep.sum())
                edges = np.flatnonzero(np.diff(np.concatenate(([True], keep, [True])).astype(np.int8)))
                run = int((edges[1::2] - edges[::2]).max())
                lines = text.split("\n")
                text = "\n".join(lines[i] for i in np.flatnonzero(keep))
            texts.append(text)
            gone.append(dropped)
            longest.append(run)
        kept = [column(part, c) for c in names]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in (totals, gone, longest))], names=[*names, "text", "n_lines", "n_deleted", "longest_run"])


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """Every row of ``docs`` with ``text`` less all later copies of runs of ``min_lines`` lines
    or more, and of single lines of ``long_words`` words or more (None: of none), ``n_lines`` before, ``n_deleted``, and ``longest_run`` of deleted lines.

    Lines end at line feeds and are compared exactly.  The first copy, by doc_id (null last),
    text and line, stays; copies may overlap and lie in one document.  Rows that repeat another
    wholly are one document and get the same result.  A null text stays null and has no lines,
    nor has an empty one.  Extra columns stay; those with the names of results or of did, tk, marks are dropped."""
    own = {"text", "n_lines", "n_deleted", "longest_run", "did", "tk", "marks"}
    names = [c for c in docs.columns if c not in own]
    marks = repeated_runs(docs, min_lines, long_words)
    rows = docs.select(*names, "text", long_key().alias("did"), text_key().alias("tk")).join(marks, ["did", "tk"], "left").select(*names, "text", "marks")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "text string, n_lines long, n_deleted long, longest_run long"])
    return by_batch(rows, lambda b: _delete(b, names), schema)
