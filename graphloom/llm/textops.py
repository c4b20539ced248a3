"""Vectorised text primitives over many texts at once (NumPy on UTF-8 bytes)."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)
#: Values that span_hashes works on at once.
SPAN_VALUES = 1 << 16


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers), 256), _BASE, np.uint64)
        grown[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(grown)
    return _powers


def _span_sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    first = np.cumsum(lengths) - lengths
    inside = np.repeat(starts - first, lengths) + np.arange(lengths.sum())
    at = inside - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        terms = (values[inside].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[at]
    sums = np.zeros(len(starts), np.uint64)
    full = lengths > 0
    if full.any():
        sums[full] = np.add.reduceat(terms, first[full])
    return sums


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each span of ``values`` (spans ascend and don't overlap).  A value takes some
    60 bytes on the way, so spans go in blocks of ``SPAN_VALUES`` or so; a longer span stands alone."""
    lengths = ends - starts
    total = np.concatenate(([0], np.cumsum(lengths)))
    sums = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        end = max(i + 1, int(np.searchsorted(total, total[i] + SPAN_VALUES, "right")) - 1)
        sums[i:end] = _span_sums(values, starts[i:end], lengths[i:end])
        i = end
    return mix(sums + lengths.astype(np.uint64) * _BASE)


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space, and each text's first word (n + 1 counts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    before |= edge[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    after |= edge[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and each text's first word (n + 1 counts)."""
    starts, ends, first = word_spans(data, offs)
    return span_hashes(data, starts, ends), first


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words; runs that cross texts are the caller's to drop."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total = total * _BASE + words[j : j + n]
    return mix(total, k)


def shingles(data: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every run of ``k`` words, in order.  A text with 1 to k - 1
    words has one shingle, of all its words; a text without words has none."""
    words, first = word_hashes(data, offs)
    counts = np.diff(first)
    runs = run_hashes(words, k)
    per = np.maximum(counts - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), per)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    out = runs[first[:-1][text] + inside] if len(text) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.array([run_hashes(words[first[i] : first[i + 1]], int(counts[i]))[0] for i in short], np.uint64)
        text, out = np.concatenate((text, short)), np.concatenate((out, extra))
        order = np.argsort(text, kind="stable")
        text, out = text[order], out[order]
    return text, out


def counted(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with their counts, sorted."""
    if not len(h):
        return text, h, np.zeros(0, np.int64)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])))
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.concatenate((at, [len(h)])))
