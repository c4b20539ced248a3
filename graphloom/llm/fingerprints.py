"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every window of five bytes adds three triplets to 256 counted buckets.  Each bucket is
encoded by the quartile of the counts it falls in, beside the length on a logarithmic
scale.  Two digests compare by a bounded difference score.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, column, flat, long_key, slices

BUCKETS = 256
#: Partitions of the id range at most; each is streamed through one task, whatever its size.
MAX_RANGES = 4096
#: Weight of one step of length (about a twelfth more bytes), and of its cap, against one quartile step.
LENGTH_WEIGHT, LENGTH_CAP = 4, 24


def _pearson() -> np.ndarray:
    """A permutation of 0..255 by a linear congruence shuffle."""
    table, state = np.arange(256, dtype=np.uint8), 12345
    for i in range(255, 0, -1):
        state = (state * 1103515245 + 12345) & 0x7FFFFFFF
        j = (state >> 8) % (i + 1)
        table[i], table[j] = table[j], table[i]
    return table


_T = _pearson()


def digest(raw: bytes | np.ndarray) -> np.ndarray:
    """258 bytes: the length code (two bytes) and the quartile 0 to 3 of every bucket.
    A text of fewer than five bytes counts as if zero bytes followed it; an empty one is all 0."""
    data = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    size = len(data)
    out = np.zeros(BUCKETS + 2, np.uint8)
    if not size:
        return out
    if size < 5:
        data = np.concatenate((data, np.zeros(5 - size, np.uint8)))
    a, b, c, d, e = (data[i : len(data) - 4 + i] for i in range(5))
    counts = np.zeros(BUCKETS, np.int64)
    for salt, x, y in ((2, b, c), (3, b, d), (5, c, e)):
        counts += np.bincount(_T[_T[_T[_T[salt] ^ a] ^ x] ^ y], minlength=BUCKETS)
    cuts = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = int(round(np.log(size) / np.log(13 / 12))) + 1
    out[0], out[1] = code >> 8, code & 255
    out[2:] = np.searchsorted(cuts, counts, "left")
    return out


def encode(found: np.ndarray) -> str:
    """Hexadecimal text of a digest: length code, then four buckets a byte."""
    q = found[2:].reshape(-1, 4)
    return found[:2].tobytes().hex() + (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).astype(np.uint8).tobytes().hex()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    q = raw[2:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
    return np.concatenate((raw[:2], q.ravel().astype(np.uint8)))


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """1 for equal digests, 0 for the largest difference there is: quartile steps (three
    apart counts six, as opposite ends) and capped length steps, over their greatest sum.
    An empty text is like an empty text alone."""
    empty = not x[:2].any(), not y[:2].any()
    if any(empty):
        return float(all(empty))
    steps = np.abs(x[2:].astype(np.int16) - y[2:])
    length = abs((int(x[0]) << 8 | int(x[1])) - (int(y[0]) << 8 | int(y[1])))
    score = int(steps.sum()) + 3 * int((steps == 3).sum()) + min(LENGTH_CAP, LENGTH_WEIGHT * length)
    return 1.0 - score / (6 * BUCKETS + LENGTH_CAP)


OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its text edited with the start of the next document's.

    Next: by doc_id (null ids last, texts of equal ids by their bytes), after the last comes
    the first; a single row is its own next.  Null reads as empty.  Repeated rows follow each
    other.  Other columns are ignored.

    Plan: ids are cut into ranges; each range is shuffled to one partition, its texts
    compressed, sorted, and streamed.  The first document of each range goes to the range
    before it as well, so that every row meets its successor without a global window.
    """
    spark = docs.sparkSession
    parts = min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))
    rows = docs.select("doc_id", "text", long_key().alias("did"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"))
    cuts = rows.agg(F.percentile_approx("did", [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).head()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))
    firsts = {r["range"]: (r["first"]["did"], r["first"]["tie"]) for r in _ranged(rows.select("did", "tie"), cuts).groupBy("range").agg(F.min(F.struct("did", "tie")).alias("first")).collect()}
    order = sorted(firsts)
    #: first document of a range -> the ranges that need it as their last successor
    before = {firsts[r]: order[i - 1] for i, r in enumerate(order)}
    schema = "range int, ghost boolean, did long, tie string, doc_id long, body binary"

    def pack(batches):
        press = zstandard.ZstdCompressor(level=1)
        arrow = pa.schema([("range", pa.int32()), ("ghost", pa.bool_()), ("did", pa.int64()), ("tie", pa.string()), ("doc_id", pa.int64()), ("body", pa.binary())])
        sent = set()
        for batch in batches:
            for part in slices(batch, "text"):
                did, tie, ids = (column(part, c).to_pylist() for c in ("did", "tie", "doc_id"))
                at = np.searchsorted(cuts, np.array(did, np.int64), "right").tolist()
                bodies = [press.compress((t or "").encode()) for t in column(part, "text").to_pylist()]
                out = [(r, False, d, t, i, b) for r, d, t, i, b in zip(at, did, tie, ids, bodies, strict=True)]
                for r, d, t, i, b in zip(at, did, tie, ids, bodies, strict=True):
                    if (d, t) in before and (d, t) not in sent:
                        sent.add((d, t))
                        out.append((before[d, t], True, d, t, i, b))
                yield batch_of(arrow, *map(list, zip(*out, strict=True)))

    packed = rows.mapInArrow(pack, schema)
    dealt = packed.repartitionById(max(1, len(cuts) + 1), F.col("range")).sortWithinPartitions("range", "ghost", "did", "tie")
    return dealt.mapInArrow(_walk, DDL)


def _ranged(keys: DataFrame, cuts: np.ndarray) -> DataFrame:
    def add(batches):
        for batch in batches:
            at = np.searchsorted(cuts, column(batch, "did").to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], names=["range", *batch.schema.names])

    return keys.mapInArrow(add, "range int, did long, tie string")


def _walk(batches):
    """Rows sorted by (range, ghost, did, tie): pairs each real row with the row after it."""
    opened = zstandard.ZstdDecompressor()
    held, made = None, []

    def close(row, text, own):
        doc_id, mine, found = row
        half = len(mine) // 2
        edited = mine[: len(mine) - half] + text[:half]
        raw = edited.encode()
        new = digest(raw)
        made.append((doc_id, len(mine), hashlib.sha256(raw).hexdigest(), encode(found), encode(new), likeness(found, new), likeness(found, own)))

    for batch in batches:
        for part in slices(batch, "body", 1 << 18):
            for ghost, doc_id, body in zip(column(part, "ghost").to_pylist(), column(part, "doc_id").to_pylist(), column(part, "body").to_pylist(), strict=True):
                raw = opened.decompress(body)
                text, own = raw.decode(), digest(raw)
                if held is not None:
                    close(held, text, own)
                held = None if ghost else (doc_id, text, own)
            if made:
                yield batch_of(OUT, *map(list, zip(*made, strict=True)))
                made.clear()
