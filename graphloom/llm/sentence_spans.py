"""Substring dedup by sliding sentence spans.

A sentence here ends with each of its clauses, after a mark or at a line's end: a passage that
begins and ends within sentences then shares all but its outermost clauses with its copies.
Every sentence starts one span: the shortest run of sentences from there that has ``WORDS``
words.  The end depends on nothing but the run's own sentences, so equal passages have equal
spans.  Spans are hashed and joined over all documents; all sentences covered by a span that
isn't the first of its kind are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_of, column, flat, long_key, slices, stored, text_key
from .textops import span_hashes, word_spans

WORDS = 24
#: Bytes of text in which equal spans are collapsed; fewer would send more rows of a common span.
EMIT_BYTES = 2 << 20

_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?,;:"]] = True
_LINE = np.zeros(256, bool)
_LINE[[10, 13]] = True


def sentences(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of all texts: begin and end byte (the white space after it included), the
    hash of its words, and its number of words; then each text's first sentence (n + 1 counts).

    A sentence ends after a word whose last byte is one of . ! ? , ; : and at the end of a line;
    text without words before it belongs to the first sentence."""
    starts, ends, first = word_spans(data, offs)
    if not len(starts):
        return *(np.zeros(0, np.int64),) * 2, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    lines = np.concatenate(([0], np.cumsum(_LINE[data])))
    last = _END[data[ends - 1]]
    last[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    last[first[1:][np.diff(first) > 0] - 1] = True
    closing = np.flatnonzero(last)
    opening = np.concatenate(([0], closing[:-1] + 1))
    count = closing - opening + 1
    head = np.searchsorted(opening, first)
    begin = starts[opening].copy()
    begin[head[:-1][np.diff(head) > 0]] = offs[:-1][np.diff(head) > 0]
    end = np.empty_like(begin)
    end[:-1] = begin[1:]
    text_end = head[1:][np.diff(head) > 0] - 1
    end[text_end] = offs[1:][np.diff(head) > 0]
    words = span_hashes(data, starts, ends)
    return begin, end, span_hashes(words, opening, closing + 1), count, head


def spans(hashes: np.ndarray, words: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, number of sentences, hash) of every span."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(head) - 1), np.diff(head))
    limit = head[1:][text]
    total = np.concatenate(([0], np.cumsum(words)))
    at = np.arange(n)
    end = np.searchsorted(total, total[at] + WORDS)
    ok = end <= limit
    at, end = at[ok], end[ok]
    size = end - at
    out = np.zeros(len(at), np.uint64)
    for k in np.unique(size):  # at most WORDS sizes
        pick = size == k
        value = np.zeros(int(pick.sum()), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(int(k)):
                value = (value ^ hashes[at[pick] + j]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(j + 1)
                value ^= value >> np.uint64(29)
        out[pick] = value
    return at, size, out


MARKS = pa.schema([("did", pa.int64()), ("tk", pa.binary()), ("h", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("later", pa.bool_())])


def _emit(batch):
    """The spans of a batch.  Of equal spans inside it only the first goes on to the global
    join; the others are known to be later copies, so that a common span shuffles one row
    a batch, not one an occurrence."""
    for part in slices(batch, "text", EMIT_BYTES):
        data, offs = flat(column(part, "text"))
        _, _, hashes, words, head = sentences(data, offs)
        at, size, h = spans(hashes, words, head)
        doc = np.searchsorted(head, at, "right") - 1
        did = column(part, "did").to_numpy()[doc]
        tk = column(part, "tk").take(pa.array(doc))
        pos = (at - head[doc]).astype(np.int32)
        _, rank = np.unique(np.array(column(part, "tk").to_pylist(), "S16"), return_inverse=True)
        tie = rank[doc] if part.num_rows else doc
        order = np.lexsort((pos, tie, did, h))
        later = np.zeros(len(h), bool)
        if len(h):
            # the first of each hash, and what repeats its row wholly, isn't a later copy
            start = np.concatenate(([True], h[order][1:] != h[order][:-1]))
            first = order[np.flatnonzero(start)[np.cumsum(start) - 1]]
            later[order] = (did[order] != did[first]) | (tie[order] != tie[first]) | (pos[order] != pos[first])
        yield batch_of(MARKS, did, tk, h.view(np.int64), pos, size.astype(np.int32), later)


def repeated(docs: DataFrame) -> DataFrame:
    """(did, tk, starts, sizes): of each document the spans that aren't the first of their kind."""
    rows = docs.select(long_key().alias("did"), text_key().alias("tk"), "text")
    found = stored(rows.mapInArrow(lambda it: (x for b in it for x in _emit(b)), "did long, tk binary, h long, pos int, size int, later boolean"))
    once = Window.partitionBy("h").orderBy("did", "tk", "pos")
    known = found.where("later").select("did", "tk", "pos", "size")
    # rows that repeat another row wholly are one document, so rank() and not row_number()
    across = found.where("not later").withColumn("r", F.rank().over(once)).where("r > 1").select("did", "tk", "pos", "size")
    marks = known.unionByName(across)
    return marks.groupBy("did", "tk").agg(F.collect_set(F.struct("pos", "size")).alias("marks"))


def _cut(batch, names):
    for part in slices(batch, "text"):
        data, offs = flat(column(part, "text"))
        begin, end, _, _, head = sentences(data, offs)
        texts = column(part, "text")
        out, total, gone = [], np.diff(head), np.zeros(part.num_rows, np.int64)
        for i, marks in enumerate(column(part, "marks").to_pylist()):
            own = texts[i].as_py()
            if marks:
                n = int(total[i])
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, [m["pos"] for m in marks], 1)
                np.add.at(step, [m["pos"] + m["size"] for m in marks], -1)
                drop = np.cumsum(step[:n]) > 0
                gone[i] = drop.sum()
                raw = data
                own = b"".join(raw[begin[head[i] + j] : end[head[i] + j]].tobytes() for j in np.flatnonzero(~drop)).decode()
            out.append(own)
        keep = [part.column(c) for c, n in enumerate(part.schema.names) if n in names]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.string()), pa.array(total), pa.array(gone)], names=[*names, "text", "n_sentences", "n_removed"])


def dedup(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with ``text`` less the sentences that a later copy of a span
    covers, ``n_sentences`` before and ``n_removed``.

    The first occurrence, by (doc_id, text, place) with null ids last, stays.  Rows that
    repeat another row wholly count as one document and get the same result.  A null text
    stays null, an empty one empty; a text is taken whole, however long, and an empty table
    stays empty.  Extra columns stay; those named n_sentences, n_removed, did, tk or marks are
    replaced or dropped."""
    own = {"text", "n_sentences", "n_removed", "did", "tk", "marks"}
    names = [c for c in docs.columns if c not in own]
    marks = stored(repeated(docs))
    rows = docs.select(*names, "text", long_key().alias("did"), text_key().alias("tk")).join(marks, ["did", "tk"], "left").select(*names, "text", "marks")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", text string, n_sentences long, n_removed long"
    return rows.mapInArrow(lambda it: (x for b in it for x in _cut(b, names)), schema.removeprefix(", "))
