"""Edit-aware token counts.

A document is cut into segments at places where every pre-token ends: before white space
that follows a word or a mark.  No token crosses such a cut, and what stands left of it
doesn't change the tokens right of it.  A segment tree over the segments holds sums of
characters and tokens.  An edit re-encodes only the segments it touches, with those of
the characters just before and after it, and updates the sums above them.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, column, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEGMENT_CHARS = 512

# Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=[\w!-/:-@\[-`{-~])(?=[ \n\t])")


@lru_cache(maxsize=2)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, size: int = SEGMENT_CHARS) -> list[str]:
    """Segments of at least ``size`` characters, but for the last."""
    out, at = [], 0
    while at < len(text):
        cut = _CUT.search(text, at + size)
        end = cut.start() if cut else len(text)
        out.append(text[at:end])
        at = end
    return out


class TokenTree:
    """One document's segments under a binary tree of sums (chars, tokens); root at 1."""

    def __init__(self, text: str, count) -> None:
        self.count = count
        self.leaves = segments(text)
        self.n_segments = len(self.leaves)
        self.reencoded = 0
        self.width = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, s in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = len(s), count(s)
        self.leaves += [""] * (self.width - len(self.leaves))
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, offset in it) of a character."""
        i = 1
        while i < self.width:
            i *= 2
            if at >= self.chars[i]:
                at -= self.chars[i]
                i += 1
        return i - self.width, at

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the characters from ``start`` to ``stop`` (held to the text) by ``new``."""
        size = self.chars[1]
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        if not size:
            first, last, offset = 0, 0, 0
        else:
            first, offset = self.find(max(start - 1, 0))
            offset += start - max(start - 1, 0)
            last, _ = self.find(min(stop, size - 1))
        region = "".join(self.leaves[first : last + 1])
        region = region[:offset] + new + region[offset + stop - start :]
        # the region's own cuts are safe as well; all of it stays in the first leaf's place
        total = sum(map(self.count, segments(region)))
        self.reencoded += len(region)
        self.leaves[first] = region
        self.chars[self.width + first], self.tokens[self.width + first] = len(region), total
        for i in range(first + 1, last + 1):
            self.leaves[i] = ""
            self.chars[self.width + i] = self.tokens[self.width + i] = 0
        low, high = (self.width + first) // 2, (self.width + last) // 2
        while low:
            for i in range(low, high + 1):
                self._sum(i)
            low, high = low // 2, high // 2

    def text(self) -> str:
        return "".join(self.leaves)

    @property
    def total(self) -> int:
        return self.tokens[1]


FIELDS = ("n_chars", "n_segments", "n_tokens", "edited_chars", "edited_tokens", "reencoded_chars")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row (doc_id, text, edits array<struct<start, stop, text>>): doc_id, and the counts of
    characters, segments and tokens before, of characters and tokens after the edits, made
    in order on the text as it then is, and of the characters encoded again for them.

    A null text is empty; null edits are none; places outside the text are held to it, a null
    place is 0, a null replacement is empty.  Extra columns are ignored, repeated rows get
    the same counts.  All of every text is counted."""

    def run(batch):
        encode = encoding(vocabulary).encode_ordinary
        count = lambda s: len(encode(s)) if s else 0
        for part in slices(batch, "text"):
            rows = []
            for text, edits in zip(column(part, "text").to_pylist(), column(part, "edits").to_pylist(), strict=True):
                tree = TokenTree(text or "", count)
                before = tree.chars[1], tree.n_segments, tree.total
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                rows.append((*before, tree.chars[1], tree.total, tree.reencoded))
            arrays = [pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), *arrays], names=["doc_id", *FIELDS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", "text", "edits"), run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in FIELDS))


def sample_edits(text: str = "text"):
    """The query's edit script: delete at a quarter, insert in the middle, replace at three quarters."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")

    def at(share: float):
        return F.floor(n * share)

    def one(start, size: int, new: str):
        return F.struct(start.alias("start"), (start + size).alias("stop"), F.lit(new).alias("text"))

    return F.array(one(at(0.25), 7, ""), one(at(0.5), 0, " [edited] "), one(at(0.75), 5, "updated"))
