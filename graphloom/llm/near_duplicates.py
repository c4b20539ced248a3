"""Near duplicates by ProbMinHash, banding and verification.

A text is a bag of five-word shingles.  Every shingle sends out a Poisson process of points
at a rate of its count; each point falls on one of the signature's places, and each place
keeps the shingle of its earliest point.  A text's processes stop once they are later than
all its places.  Two signatures agree on a place with the probability Jaccard similarity of
their texts, which is computed exactly for what bands propose.

Equal texts are one node.  A bucket of a band doesn't send out all pairs: its members are
compared with two of them, those that share buckets with most others, and links are joined
into classes.  Buckets that hold several classes after that are open.  Of their members only
pairs of different classes are left that pass an exact bound.

The bound comes from the rarest shingles.  In one order of all shingles, rare ones first, let
w be the first that two bags of sizes X and Y share, and a and b the shares of X and Y before
w.  No shingle before w is shared, so that the similarity is at most
(1 - a)(1 - b) / (1 - ab), and, with s = min((1 - a)X, (1 - b)Y) and the shares r and q of
shingles that a bag holds more than once, at most s / (X + Y - s) + r + q.  A shingle of a link
lies in the first fifth of either bag, and copies that differ from a common text in places of
their own fail the second bound unless they are links.  A class enters this join as bins of
its members' figures, so that a large class costs a few rows a shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_batch, column, flat, long_key, release, slices, stored, text_key
from .components import components
from .textops import counted, mix, shingles

SHINGLE, SIMILARITY = 5, 0.8
#: A sum of shares that makes up 0.8 in numbers may come out this much lower in floats.
ROUNDING = 1e-9
#: A pair at a similarity of 0.8 shares no band with odds of (1 - 0.8 ** 4) ** 20, 1 to 38,000.
BANDS, ROWS = 20, 4
PLACES = BANDS * ROWS
#: Members that all others of a bucket are compared with; what stays open goes through the bound.
HUBS = 2
#: Bins a unit of a member's share before a shingle, of its size's logarithm and of its repeats.
BINS = 50


def signatures(text: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, places: int = PLACES) -> np.ndarray:
    """Signatures [text, place]: the shingle of the earliest point; 0 for texts without shingles.
    Input: the distinct shingles of all texts, in order of text."""
    best = np.full((texts, places), np.inf)
    out = np.zeros((texts, places), np.uint64)
    if not len(h):
        return out
    flat_best, flat_out = best.ravel(), out.ravel()
    arrival = np.zeros(len(h))
    rate = weight.astype(float)
    at = np.arange(len(h))
    turn = 0
    while len(at):
        noise = mix(h[at], 2 * turn + 1)
        arrival[at] += -np.log((noise >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / rate[at]
        place = text[at] * places + (mix(h[at], 2 * turn + 2) % np.uint64(places)).astype(np.int64)
        time = arrival[at]
        order = np.lexsort((time, place))
        first = order[np.concatenate(([True], place[order][1:] != place[order][:-1]))]
        better = first[time[first] < flat_best[place[first]]]
        flat_best[place[better]] = time[better]
        flat_out[place[better]] = h[at[better]]
        # early termination: later points of a process only get later
        latest = best[np.unique(text[at])].max(1)
        limit = np.full(texts, -1.0)
        limit[np.unique(text[at])] = latest
        at = at[arrival[at] < limit[text[at]]]
        turn += 1
    return out


def bands(signature: np.ndarray, count: int = BANDS) -> np.ndarray:
    """The bucket of every band: a hash of its places, salted by the band."""
    rows = signature.shape[1] // count
    parts = signature.reshape(len(signature), count, rows)
    value = np.zeros((len(signature), count), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            value = value * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r]
        value += np.arange(count, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    return mix(value, 7).view(np.int64)


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two bags (sorted shingles, counts): the sum over
    shared d of 1 / sum over e of max(x_e / x_d, y_e / y_d)."""
    both = np.union1d(x[0], y[0])
    a, b = np.zeros(len(both)), np.zeros(len(both))
    a[np.searchsorted(both, x[0])], b[np.searchsorted(both, y[0])] = x[1], y[1]
    with np.errstate(divide="ignore"):
        ratio = a / b
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    # e with a larger ratio count x_e / x_d, the others y_e / y_d
    high = a.sum() - np.cumsum(a)
    low = np.cumsum(b)
    shared = (a > 0) & (b > 0)
    return float((1 / (high[shared] / a[shared] + low[shared] / b[shared])).sum())


def _signed(batch, keys: tuple[str, ...], count: int, rows: int):
    """Rows (keys, bands) of texts; no bands where there are no words."""
    for part in slices(batch, "text"):
        text, h = shingles(*flat(column(part, "text")), SHINGLE)
        text, h, weight = counted(text, h)
        found = bands(signatures(text, h, weight, part.num_rows, count * rows), count)
        some = np.zeros(part.num_rows, bool)
        some[text] = True
        offsets = np.concatenate(([0], np.cumsum(np.where(some, count, 0)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[some].ravel()))
        yield pa.RecordBatch.from_arrays([*(column(part, k) for k in keys), lists], names=[*keys, "bands"])


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    t, h = shingles(*flat(pa.array([text], pa.large_string())), SHINGLE)
    _, h, w = counted(t, h)
    return h, w.astype(float)


def _verified(batch):
    """Pairs (a, b, x, y) with their similarity; bags of one side's text are kept while it repeats."""
    memo: dict[bytes, tuple] = {}

    def of(key, text):
        if key not in memo:
            if len(memo) > 256:
                memo.clear()
            memo[key] = bag(text)
        return memo[key]

    for part in slices(batch, "y", 1 << 20):
        a, b, x, y = (column(part, c).to_pylist() for c in ("a", "b", "x", "y"))
        found = [similarity(of(i, s), of(j, t)) for i, j, s, t in zip(a, b, x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([column(part, "a"), column(part, "b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])


def _weighed(batch):
    """(tk, size, repeats, shingle, count) of every shingle of a text: ``size`` is the bag's, ``repeats``
    the share of shingles that it holds more than once."""
    for part in slices(batch, "text"):
        text, h = shingles(*flat(column(part, "text")), SHINGLE)
        text, h, count = counted(text, h)
        size = np.bincount(text, count, part.num_rows)
        twice = np.bincount(text, np.where(count > 1, count, 0), part.num_rows) / np.maximum(size, 1)
        yield pa.RecordBatch.from_arrays([column(part, "tk").take(pa.array(text)), pa.array(size[text]), pa.array(twice[text]), pa.array(h.view(np.int64)), pa.array(count.astype(np.int32))], names=["tk", "size", "repeats", "shingle", "count"])


def _bound(x: str, y: str, threshold: float):
    """Whether the similarity of rows or bins ``x`` and ``y`` can reach the threshold; a bin has the
    least share before the shingle, the sizes from low to high, and the most repeats."""
    a, b = F.col(f"{x}.share"), F.col(f"{y}.share")
    shared = F.least((1 - a) * F.col(f"{x}.high"), (1 - b) * F.col(f"{y}.high"))
    flat_ = shared / F.greatest(F.col(f"{x}.low") + F.col(f"{y}.low") - shared, shared) + F.col(f"{x}.repeats") + F.col(f"{y}.repeats")
    return ((1 - a) * (1 - b) >= (threshold - ROUNDING) * (1 - a * b) - ROUNDING) & (flat_ >= threshold - ROUNDING)


def bounded_pairs(texts: DataFrame, labels: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """All pairs (a, b) of ``texts`` (tk, text) whose ``labels`` (tk, label) differ and whose similarity
    can reach ``threshold`` by their rarest shingles.  Every pair that does reach it is there."""
    bags = stored(by_batch(texts, _weighed, "tk binary, size double, repeats double, shingle long, count int"))
    often = bags.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    ranked = Window.partitionBy("tk").orderBy(F.coalesce("n", F.lit(1)), "shingle")
    share = (F.sum("count").over(ranked) - F.col("count")) / F.col("size")
    rows = bags.join(often, "shingle", "left").withColumn("share", share)
    # a shingle of one text alone pairs nothing
    rows = rows.where(F.col("n").isNotNull() & (F.col("share") <= 1 - threshold + ROUNDING))
    rows = stored(rows.select("shingle", "tk", "share", "repeats", F.col("size").alias("low"), F.col("size").alias("high")).join(labels, "tk"))
    release(bags)
    bin_ = [F.floor(F.col("share") * BINS).alias("i"), F.floor(F.log("low") * BINS).alias("j"), F.ceil(F.col("repeats") * BINS).alias("k")]
    binned = rows.select("*", *bin_)
    key = ["shingle", "label", "i", "j", "k"]
    bins = binned.groupBy(*key).agg(F.min("share").alias("share"), F.max("repeats").alias("repeats"), F.min("low").alias("low"), F.max("high").alias("high"))
    x, y = bins.alias("x"), bins.alias("y")
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") < F.col("y.label")) & _bound("x", "y", threshold))
    met = stored(met.select(*(F.col(f"x.{c}").alias(f"x_{c}") for c in key), *(F.col(f"y.{c}").alias(f"y_{c}") for c in key[1:])))
    one = binned.select(F.struct("tk", "share", "low", "high", "repeats").alias("x"), *(F.col(c).alias(f"x_{c}") for c in key))
    two = binned.select(F.struct("tk", "share", "low", "high", "repeats").alias("y"), F.col("shingle").alias("x_shingle"), *(F.col(c).alias(f"y_{c}") for c in key[1:]))
    pairs = met.join(one, [f"x_{c}" for c in key])
    on = ["x_shingle", *(f"y_{c}" for c in key[1:])]
    pairs = pairs.alias("p").join(two.alias("q"), [F.col(f"p.{c}") == F.col(f"q.{c}") for c in on] + [_bound("x", "y", threshold)])
    return pairs.select(F.least("x.tk", "y.tk").alias("a"), F.greatest("x.tk", "y.tk").alias("b")).distinct()


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    x, y = (texts.select(F.col("tk").alias(k), F.col("text").alias(t)) for k, t in (("a", "x"), ("b", "y")))
    found = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return stored(by_batch(found, _verified, "a binary, b binary, similarity double"))


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(did, tk, class_did, class_tk, worded) for every distinct document (id and text).

    A class is what links of similarity ``threshold`` or more join; it is named by its first
    document, by id (null last) and then text.  A text with one to four words is one shingle
    of all its words; null, empty and other texts without words are never linked, not even to
    each other.  Rows that repeat another wholly are one document here.  A text is signed and
    compared whole, however long.  An empty table has no classes."""
    rows = docs.select(long_key().alias("did"), text_key().alias("tk"), "text")
    signed = stored(by_batch(rows, lambda b: _signed(b, ("did", "tk"), BANDS, ROWS), "did long, tk binary, bands array<long>"))
    nodes = stored(signed.where("size(bands) > 0").groupBy("tk").agg(F.min("did").alias("did"), F.first("bands").alias("bands")))
    spread = nodes.select("tk", F.explode("bands").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(spread.join(full, "bucket").select("bucket", "tk", "n"))
    central = members.groupBy("tk").agg(F.sum("n").alias("weight"))
    # the texts of all that share a bucket, one row for each
    wanted = members.select("tk").distinct().join(nodes.select("tk", "did"), "tk")
    texts = stored(rows.join(wanted, ["did", "tk"], "left_semi").groupBy("tk").agg(F.first("text").alias("text")))
    first = Window.partitionBy("bucket").orderBy(F.desc("weight"), "tk")
    hubs = members.join(central, "tk").withColumn("r", F.row_number().over(first)).where(F.col("r") <= HUBS)
    pairs = members.join(hubs.select("bucket", F.col("tk").alias("hub")), "bucket").where("tk <> hub")
    checked = _verify(pairs.select(F.least("tk", "hub").alias("a"), F.greatest("tk", "hub").alias("b")).distinct(), texts)
    near = F.col("similarity") >= threshold - ROUNDING
    links, labels = checked.where(near).select("a", "b"), None
    if not links.isEmpty():
        labels = components(links).select(F.col("node").alias("tk"), F.col("component").alias("label"))
    here = members.select("bucket", "tk", F.col("tk").alias("label")) if labels is None else members.join(labels, "tk", "left").select("bucket", "tk", F.coalesce("label", "tk").alias("label"))
    here = stored(here)
    open_ = here.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    left = stored(here.join(open_.select("bucket"), "bucket", "left_semi").select("tk", "label").distinct())
    release(here)
    if not left.isEmpty():
        pairs = bounded_pairs(texts.join(left.select("tk"), "tk", "left_semi"), left, threshold)
        more = _verify(pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti"), texts).where(near).select("a", "b")
        if not more.isEmpty():
            labels = components(links.unionByName(more)).select(F.col("node").alias("tk"), F.col("component").alias("label"))
    release(texts)
    named = nodes.select("tk", "did")
    if labels is not None:
        named = named.join(labels, "tk", "left")
    else:
        named = named.withColumn("label", F.lit(None).cast("binary"))
    heads = named.groupBy(F.coalesce("label", "tk").alias("label")).agg(F.min(F.struct("did", "tk")).alias("head"))
    heads = named.select("tk", F.coalesce("label", "tk").alias("label")).join(heads, "label").select("tk", "head")
    distinct = signed.groupBy("did", "tk").agg(F.max(F.size("bands")).alias("n"))
    out = distinct.join(heads, "tk", "left")
    out = out.select("did", "tk", F.coalesce("head.did", "did").alias("class_did"), F.coalesce("head.tk", "tk").alias("class_tk"), (F.col("n") > 0).alias("worded"))
    return stored(out)


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and is_first of every row of ``docs``: class_id is the doc_id of the
    class's first document, is_first whether this row is that document.  See classes()."""
    last = (1 << 63) - 1
    found = classes(docs, threshold)
    rows = docs.select("doc_id", long_key().alias("did"), text_key().alias("tk"))
    return rows.join(found, ["did", "tk"]).select("doc_id", F.when(F.col("class_did") != last, F.col("class_did")).alias("class_id"), ((F.col("did") == F.col("class_did")) & (F.col("tk") == F.col("class_tk"))).alias("is_first"))


def deduplicate(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class, all columns; rows without words all stay.

    Of rows with the first document's id and text the one whose columns have the smallest
    hash stays, so that the choice doesn't depend on the partitioning.  Extra columns stay,
    whatever their names; an empty table stays empty."""
    found = classes(docs, threshold)
    keys = found.where("worded and did = class_did and tk = class_tk").select("did", "tk")
    bare = found.where("not worded").select("did", "tk")
    mine = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(F.struct(*mine).alias("row"), F.xxhash64(*(F.col(c) for c in docs.columns)).alias("order"), long_key().alias("did"), text_key().alias("tk"))
    first = rows.join(keys, ["did", "tk"]).groupBy("did", "tk").agg(F.min_by("row", "order").alias("row"))
    out = first.select("row").unionByName(rows.join(bare, ["did", "tk"], "left_semi").select("row"))
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
