"""Benchmark decontamination by SimHash of item-sized windows.

A document is contaminated by an item if a window of as many words as the item (the whole
document if it is shorter) has a weighted Jaccard similarity of ``SIMILARITY`` or more over
five-word shingles with their counts.  Windows are fingerprinted by SimHash and looked up in
a multi-index: fingerprints within ``RADIUS`` bits of each other differ by ``NEAR`` bits at most
in one of ``BLOCKS`` blocks of 32 bits, so none is missed, and of unrelated ones 1 in 100 gets
so far.  What is found is verified exactly.

A window that is similar to an item holds one of the item's rarest shingles: at 0.8 it lacks a
fifth of them at most.  Only windows and items that share one of these are looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, flat, map_arrow, slices, stored, text_key
from .textops import mix, run_hashes, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 the mean distance of 256 bits is 39 and its deviation 6, so a window
#: over the similarity lies outside with odds of 1 to 50,000.
BITS, RADIUS = 256, 63
BLOCKS = BITS // 32
NEAR = RADIUS // BLOCKS
#: Bytes of benchmark text in one broadcast; a larger benchmark is matched in blocks of this size.
BENCHMARK_BYTES = 16 << 20
#: Windows fingerprinted, and hits taken, at once; bounds memory on texts that match all over.
WINDOWS, HITS = 2048, 1 << 20


def signs(h: np.ndarray) -> np.ndarray:
    """The +1 and -1 that shingles add to a fingerprint's bits."""
    words = np.stack([mix(h, 101 + i) for i in range(BITS // 64)], 1)
    return (np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def simhashes(h: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Packed fingerprints of the windows of ``width`` shingles from each start in ``h``."""
    total = np.zeros((len(h) + 1, BITS), np.int32)
    np.cumsum(signs(h), axis=0, out=total[1:])
    return np.packbits(total[starts + width] - total[starts] > 0, axis=1)


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    both, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = np.bincount(at[: len(x)], minlength=len(both)), np.bincount(at[len(x) :], minlength=len(both))
    return float(np.minimum(a, b).sum() / np.maximum(a, b).sum())


def near_blocks(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multi-index: (row of x, row of y, distances by block) of fingerprints with a block within ``NEAR`` bits."""
    x, y = (np.ascontiguousarray(v).view(np.uint32) for v in (x, y))
    near = np.zeros((len(x), len(y)), bool)
    for b in range(BLOCKS):
        near |= np.bitwise_count(x[:, None, b] ^ y[None, :, b]) <= NEAR
    i, j = np.nonzero(near)
    return i, j, np.bitwise_count(x[i] ^ y[j])


class Index:
    """The items of one block of the benchmark."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        arr = pa.array([t for _, t in items], pa.large_string())
        words, first = word_hashes(*flat(arr))
        self.ids, self.shingles, sizes = [], [], []
        for i, (item_id, _) in enumerate(items):
            own = words[first[i] : first[i + 1]]
            if len(own):
                self.ids.append(item_id)
                self.shingles.append(run_hashes(own, min(SHINGLE, len(own))))
                sizes.append(len(own))
        self.sizes = np.array(sizes, np.int64)
        owner = np.repeat(np.arange(len(self.ids)), [len(s) for s in self.shingles])
        every = np.concatenate(self.shingles) if self.shingles else np.zeros(0, np.uint64)
        # of each item the rarest shingles, one more than a similar window can lack
        known, at, often = np.unique(every, return_inverse=True, return_counts=True)
        order = np.lexsort((every, often[at] if len(at) else at, owner))
        owner, every = owner[order], every[order]
        count = np.bincount(owner, minlength=len(self.ids))
        place = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        rare = place <= count[owner] - np.ceil(SIMILARITY * count[owner] - 1e-9)
        owner, every = owner[rare], every[rare]
        order = np.lexsort((owner, every))
        owner, every = owner[order], every[order]
        new = np.concatenate(([True], (every[1:] != every[:-1]) | (owner[1:] != owner[:-1]))) if len(every) else np.zeros(0, bool)
        self.keys, self.owners = every[new], owner[new]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        prints = [simhashes(s, np.zeros(1, np.int64), len(s)) for s in self.shingles]
        self.prints = np.concatenate(prints) if prints else np.zeros((0, BITS // 8), np.uint8)

    def hits(self, runs: np.ndarray):
        """(place, item) of all runs that are a rare shingle of an item, in pieces of bounded size."""
        near = np.flatnonzero(self.filter[(runs >> np.uint64(42)).astype(np.int64)])
        low = np.searchsorted(self.keys, runs[near], "left")
        count = np.searchsorted(self.keys, runs[near], "right") - low
        near, low, count = near[count > 0], low[count > 0], count[count > 0]
        total = np.cumsum(count)
        i = 0
        while i < len(near):
            end = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + HITS, "right")))
            n = count[i:end]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(near[i:end], n), self.owners[np.repeat(low[i:end], n) + inside]
            i = end

    def candidates(self, prints: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all of ``items`` within the radius."""
        found = []
        step = max(1, (1 << 19) // max(1, len(items)))
        for i in range(0, len(prints), step):
            w, m, blocks_ = near_blocks(prints[i : i + step], self.prints[items])
            d = blocks_.sum(1, dtype=np.int64)
            ok = d <= RADIUS
            found.append((w[ok] + i, items[m[ok]], d[ok]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def matches(self, data: np.ndarray, offs: np.ndarray) -> list[tuple]:
        """(text, item, similarity, first word, words, distance): the best window of each
        contaminated text and item, the first of equal ones."""
        words, first = word_hashes(data, offs)
        counts = np.diff(first)
        best: dict[tuple[int, int], tuple] = {}
        for k in range(1, SHINGLE + 1):
            mine = self.sizes == k if k < SHINGLE else self.sizes >= SHINGLE
            texts = counts >= k
            # a text under five words is one shingle, which no item of five words or more has
            if not mine.any() or not texts.any():
                continue
            runs = run_hashes(words, k)
            for place, item in self.hits(runs):
                text = np.searchsorted(first, place, "right") - 1
                ok = mine[item] & (place + k <= first[text + 1])
                self._windows(runs, k, first, counts, place[ok], item[ok], text[ok], best)
        return [(t, j, *v) for (t, j), v in sorted(best.items())]

    def _windows(self, runs, k, first, counts, place, item, text, best) -> None:
        if not len(place):
            return
        order = np.lexsort((place, self.sizes[item], text))
        place, item, size, text = place[order], item[order], self.sizes[item][order], text[order]
        cuts = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (size[1:] != size[:-1]))))
        for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
            t, words = int(text[a]), int(size[a])
            window = min(words, int(counts[t]))
            width = window - k + 1
            local, items = np.unique(place[a:b]) - first[t], np.unique(item[a:b])
            # starts of all windows that hold one of the hits, as merged ranges
            low, high = np.maximum(local - width + 1, 0), np.minimum(local, counts[t] - window)
            delta = np.zeros(int(high.max()) - int(low.min()) + 2, np.int32)
            np.add.at(delta, low - low.min(), 1)
            np.add.at(delta, high + 1 - low.min(), -1)
            starts = np.flatnonzero(np.cumsum(delta[:-1]) > 0) + int(low.min())
            i = 0
            while i < len(starts):
                part = starts[i : i + WINDOWS]
                part = part[part < part[0] + 2 * WINDOWS]
                i += len(part)
                h = runs[first[t] + part[0] : first[t] + part[-1] + width]
                for w, j, d in zip(*self.candidates(simhashes(h, part - part[0], width), items), strict=True):
                    at = int(part[w])
                    value = overlap(h[at - part[0] : at - part[0] + width], self.shingles[j])
                    if value >= SIMILARITY and value > best.get((t, int(j)), (0,))[0]:
                        best[t, int(j)] = (value, at, window, int(d))


def blocks(benchmark: DataFrame, limit: int = BENCHMARK_BYTES):
    """The benchmark's distinct items in lists of ``limit`` bytes or so; only one is held at a time."""
    rows = benchmark.where("text is not null").select(F.col("item_id"), "text").distinct()
    part, size = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        part.append((r["item_id"], r["text"]))
        size += len(r["text"].encode())
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


ITEM = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _by_block(docs: DataFrame, benchmark: DataFrame, limit: int, fn, schema):
    """``fn(index, batch)`` over all of ``docs`` for each block of the benchmark, all results together.
    A block's index is let go of before the next one is built, unless there is one block only."""
    context = docs.sparkSession.sparkContext
    parts = blocks(benchmark, limit)
    part, out = next(parts, None), None
    while part is not None:
        shared, after = context.broadcast(Index(part)), next(parts, None)

        def run(batches, shared=shared):
            for batch in batches:
                for rows in slices(batch, "text"):
                    yield from fn(shared.value, rows)

        one = map_arrow(docs, run, schema)
        if after is not None or out is not None:
            one = stored(one)
            shared.destroy()
        out = one if out is None else out.unionByName(one)
        part = after
    return out


def find(docs: DataFrame, benchmark: DataFrame, limit: int = BENCHMARK_BYTES) -> DataFrame:
    """One row for each contaminated row of ``docs`` and item: doc_id, item_id, similarity,
    first_word, n_words and distance (of fingerprints) of the best window, of equal ones the first.

    Null and empty texts and items match nothing; repeated items count once, repeated
    documents each give rows; extra columns are ignored, whatever their names.  An item under five
    words is one shingle of all its words, as is a window of its size.  Texts are searched whole,
    however long; an empty table on either side gives no rows."""
    key = docs.schema["doc_id"].dataType.simpleString()
    item = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {key}, item_id {item}, similarity double, first_word long, n_words long, distance long"

    def run(index, rows):
        found = index.matches(*flat(column(rows, "text")))
        if found:
            t, j, s, at, n, d = map(list, zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id").take(pa.array(t)), pa.array([index.ids[i] for i in j], ITEM[item]), pa.array(s), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["doc_id", "item_id", "similarity", "first_word", "n_words", "distance"])

    out = _by_block(docs.select("doc_id", "text"), benchmark, limit, run, schema)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, limit: int = BENCHMARK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that no item contaminates; see find()."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).head()[0]
    if size is None:
        return docs
    if size < limit:  # one block

        def keep(index, rows):
            ok = np.ones(rows.num_rows, bool)
            ok[[m[0] for m in index.matches(*flat(column(rows, "text")))]] = False
            yield rows.filter(pa.array(ok))

        out = _by_block(docs, benchmark, limit, keep, docs.schema)
        return docs if out is None else out

    def texts(index, rows):
        bad = sorted({m[0] for m in index.matches(*flat(column(rows, "text")))})
        yield pa.RecordBatch.from_arrays([column(rows, "tk").take(pa.array(bad, pa.int64()))], names=["tk"])

    bad = _by_block(docs.select(text_key().alias("tk"), "text"), benchmark, limit, texts, "tk binary").distinct()
    names = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    kept = docs.select(F.struct(*names).alias("row"), text_key().alias("tk")).join(bad, "tk", "left_anti")
    return kept.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
