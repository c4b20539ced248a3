"""Quality classifier by co-training.

Two logistic classifiers see different views of a document: its text (hashed byte
trigrams) and its page metadata (source, language, size and layout).  They start from a
bounded sample of labelled rows.  In each round both score all other documents, and what
one is sure of goes to the other as pseudo-labels: one pass over the corpus sums the
gradient and the Hessian of a Newton step, by partition and then by a tree.  At the end
the views are calibrated and combined on held-out labelled rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, flat, map_arrow, slices, stored, tree_sum
from .textops import word_hashes

#: The bound on labelled rows that the classifiers are fitted on; more are sampled by a hash of the id.
LABELLED_ROWS = 20_000
ROUNDS, SURE, RIDGE = 3, 0.98, 2.0
TEXT_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS = 128, 32, 16
#: Bytes of packed features that one step sums, in numbers four times as long and several copies.
GATHER_BYTES = 1 << 18
TEXT_DIM, META_DIM = TEXT_BUCKETS + 4, SOURCE_BUCKETS + LANG_BUCKETS + 9

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True


def _share(values: np.ndarray, offs: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return (total[offs[1:]] - total[offs[:-1]]) / size


def features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(text view, metadata view) of the rows (text, source, lang); last column: 1."""
    data, offs = flat(column(part, "text"))
    n, size = part.num_rows, np.maximum(np.diff(offs), 1)
    text, meta = np.zeros((n, TEXT_DIM), np.float32), np.zeros((n, META_DIM), np.float32)
    wide = data.astype(np.uint32)
    h = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)) if len(data) > 2 else np.zeros(0, np.uint32)
    buckets = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(25)).astype(np.int64)
    hashes, first = word_hashes(data, offs)
    words = np.maximum(np.diff(first), 1)
    low = (hashes & np.uint64(4095)).astype(np.int64)
    for i in range(n):
        if offs[i + 1] - offs[i] >= 3:
            c = np.bincount(buckets[offs[i] : offs[i + 1] - 2], minlength=TEXT_BUCKETS)
            p = c / c.sum()
            text[i, :TEXT_BUCKETS] = np.sqrt(p)
            text[i, TEXT_BUCKETS] = -(p[p > 0] * np.log(p[p > 0])).sum()
            text[i, TEXT_BUCKETS + 1] = p.max()
        own = np.bincount(low[first[i] : first[i + 1]], minlength=1)
        text[i, TEXT_BUCKETS + 2] = own.max() / words[i]
        meta[i, -2] = np.count_nonzero(own) / min(words[i], 4096)
    text[:, -1] = meta[:, -1] = 1
    rows = np.arange(n)
    for name, at, width in (("source", 0, SOURCE_BUCKETS), ("lang", SOURCE_BUCKETS, LANG_BUCKETS)):
        meta[rows, [at + zlib.crc32((x or "").encode()) % width for x in column(part, name).to_pylist()]] = 1
    at = SOURCE_BUCKETS + LANG_BUCKETS
    lines = _share(data == 10, offs, size) * size + 1
    meta[:, at] = np.log1p(np.diff(offs))
    meta[:, at + 1] = np.log(lines)
    meta[:, at + 2] = np.log(np.maximum(np.diff(first), 1) / lines)
    meta[:, at + 3] = np.log(size / words)
    meta[:, at + 4] = _share(~_ALNUM[data], offs, size) - np.diff(first) / size
    meta[:, at + 5] = _share((data >= 65) & (data <= 90), offs, size)
    meta[:, at + 6] = _share((data >= 48) & (data <= 57), offs, size)
    return text, meta


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def newton_terms(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss."""
    p = sigmoid(x @ beta)
    return x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x


def loss(x: np.ndarray, y: np.ndarray, beta: np.ndarray, ridge: float) -> float:
    z = x @ beta
    return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * beta @ beta)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 15, ridge: float = RIDGE) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        beta = step(beta, *newton_terms(x, y, beta), x, y, ridge)
    return beta


def step(beta: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, slack: float = 0.0) -> np.ndarray:
    """A Newton step, halved until the loss on the labelled rows (x, y) rises by no more than
    the share ``slack``; none if it always does."""
    move = np.linalg.solve(hessian + ridge * np.eye(len(beta)), gradient + ridge * beta)
    most = loss(x, y, beta, ridge) * (1 + slack)
    for k in range(12):
        new = beta - move / 2**k
        if loss(x, y, new, ridge) <= most:
            return new
    return beta


class Model:
    """Scales and weights of both views, and their calibrated combination."""

    def __init__(self, scales, betas, blend) -> None:
        self.scales, self.betas, self.blend = scales, betas, blend

    def logits(self, views) -> list[np.ndarray]:
        return [scaled(v, s) @ b for v, s, b in zip(views, self.scales, self.betas, strict=True)]

    def scores(self, views) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (np.clip(x, -30, 30) for x in self.logits(views))
        return sigmoid(a), sigmoid(b), sigmoid(np.stack([a, b, np.ones_like(a)], 1) @ self.blend)


def scaled(view: np.ndarray, scale: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip((view - scale[0]) / scale[1], -8, 8)


def _scale(view: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, spread = view.mean(0, dtype=float), view.std(0, dtype=float)
    mean[-1], spread[-1] = 0, 1
    return mean, np.where(spread < 1e-6, 1, spread)


def sampled_labels(labels: DataFrame, target: str, bound: int) -> DataFrame:
    """(did, y): ids whose rows agree on a label 0 or 1, about ``bound`` of them at most, by a hash of the id."""
    one = labels.where(f"doc_id is not null and {target} in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("did"))
    one = one.agg(F.min(target).alias("y"), F.max(target).alias("most")).where("y = most").select("did", F.col("y").cast("int").alias("y"))
    share = min(1.0, bound / max(1, one.count()))
    return one.where(F.pmod(F.xxhash64("did"), F.lit(1 << 30)) < int(share * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", bound: int = LABELLED_ROWS, rounds: int = ROUNDS) -> Model | None:
    """The co-trained model; None if the sample doesn't hold both labels, in both folds."""
    known = sampled_labels(labels, target, bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("did"), "text", "source", "lang")
    # at most about ``bound`` rows of twelve bytes each
    rows = rows.join(F.broadcast(known), "did", "left")
    kinds = pa.schema([("did", pa.int64()), ("y", pa.int32()), ("x", pa.binary())])

    def compute(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.concatenate(features(part), 1).astype(np.float16)
                yield pa.RecordBatch.from_arrays([column(part, "did"), column(part, "y"), pa.array([r.tobytes() for r in x], pa.binary())], schema=kinds)

    table = stored(map_arrow(rows, compute, "did long, y int, x binary"))
    found = table.where("y is not null").dropDuplicates(["did", "x"]).orderBy("did", "x").toPandas()
    if not len(found):
        return None
    x = np.frombuffer(b"".join(found["x"]), np.float16).reshape(len(found), -1).astype(np.float64)
    y = found["y"].to_numpy(float)
    fold = np.array([zlib.crc32(str(d).encode()) % 4 == 0 for d in found["did"]])
    if any(len(set(y[part])) < 2 for part in (fold, ~fold)):
        return None
    views = [x[:, :TEXT_DIM], x[:, TEXT_DIM:]]
    scales = [_scale(v[~fold]) for v in views]
    own = [scaled(v, s) for v, s in zip(views, scales, strict=True)]
    betas = [fit(v[~fold], y[~fold]) for v in own]
    unlabelled = table.where("y is null").select("x")
    sc = docs.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast((scales, betas))

        def gather(batches, shared=shared):
            scale, beta = shared.value
            sums = None
            for part in (s for batch in batches for s in slices(batch, "x", GATHER_BYTES)):
                raw = np.frombuffer(b"".join(column(part, "x").to_pylist()), np.float16).reshape(part.num_rows, -1).astype(np.float64)
                v = [scaled(raw[:, :TEXT_DIM], scale[0]), scaled(raw[:, TEXT_DIM:], scale[1])]
                p = [sigmoid(a @ b) for a, b in zip(v, beta, strict=True)]
                made = []
                for mine, other in ((0, 1), (1, 0)):
                    sure = (p[other] >= SURE) | (p[other] <= 1 - SURE)
                    g, h = newton_terms(v[mine][sure], (p[other][sure] > 0.5).astype(float), beta[mine])
                    made += [np.array([sure.sum()], float), g, h.ravel()]
                sums = made if sums is None else [a + b for a, b in zip(sums, made, strict=True)]
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.concatenate(sums).tobytes()], pa.binary())], names=["k", "sums"])

        got = tree_sum(map_arrow(unlabelled, gather, "k int, sums binary"), ["k"], "sums", "float64").collect()
        at, total = 0, np.frombuffer(got[0]["sums"], np.float64) if got else None
        for i, dim in enumerate((TEXT_DIM, META_DIM)):
            g, h = newton_terms(own[i][~fold], y[~fold], betas[i])
            if total is not None:
                n, more_g, more_h = total[at], total[at + 1 : at + 1 + dim], total[at + 1 + dim : at + 1 + dim + dim * dim]
                at += 1 + dim + dim * dim
                # together pseudo-labels weigh no more than the labelled rows
                weight = min(1.0, (~fold).sum() / n) if n else 0.0
                g, h = g + weight * more_g, h + weight * more_h.reshape(dim, dim)
            betas[i] = step(betas[i], g, h, own[i][~fold], y[~fold], slack=0.05)
    held = np.stack([*(np.clip(v[fold] @ b, -30, 30) for v, b in zip(own, betas, strict=True)), np.ones(int(fold.sum()))], 1)
    return Model(scales, betas, fit(held, y[fold], ridge=0.1))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """Every row of ``docs``, all columns, with text_score, meta_score, quality_score (0 to 1) and keep.

    One pass without a shuffle.  Without a model the scores are null and all rows are kept."""
    added = ("text_score", "meta_score", "quality_score", "keep")
    names = [c for c in docs.columns if c not in added]
    base = docs.select(*names)
    if model is None:
        return base.select(*names, *(F.lit(None).cast("double").alias(c) for c in added[:3]), F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                scores = shared.value.scores(features(part))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(s, pa.float64()) for s in scores), pa.array(scores[2] >= threshold)], names=[*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", text_score double, meta_score double, quality_score double, keep boolean"
    return map_arrow(base, run, schema)


def classify(docs: DataFrame, labels: DataFrame, target: str = "quality", **options) -> DataFrame:
    """Train on ``labels`` (doc_id, ``target`` 0/1) and score all ``docs`` (doc_id, text, source, lang, ...).

    Null text, source and lang read as empty; a document with a null id is never labelled;
    ids labelled both 0 and 1 count as unlabelled; repeated rows get equal scores.  Empty
    tables, or labels of one kind alone, give null scores and keep all rows."""
    return score(docs, train(docs, labels, target, **options))
