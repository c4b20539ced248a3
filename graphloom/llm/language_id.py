"""Language ID by mixtures: each text is a mixture of languages' n-gram models.

Models are hashed byte-trigram distributions, one per language, counted over all
training documents.  For each text, expectation-maximisation finds the proportions of
the languages; languages then leave the set one by one while the likelihood lost is
less than the penalty for a parameter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, by_batch, column, flat, slices, tree_sum

BUCKETS = 1 << 13
PENALTY = 3.0
MODEL_LIMIT_MB = 512

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FOLD[~_LETTER & (np.arange(256) < 128)] = 32


def grams(data: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes from each byte on; case and ASCII signs are folded."""
    x = _FOLD[data]
    if len(x) < 3:
        return np.zeros(0, np.int64)
    h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)).astype(np.uint32)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19)).astype(np.int64)


def learn(training: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [language, bucket]) from rows (text, lang)."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                data, offs = flat(column(part, "text"))
                ids = grams(data)
                for i, lang in enumerate(column(part, "lang").to_pylist()):
                    own = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    if offs[i + 1] - offs[i] >= 3:
                        own += np.bincount(ids[offs[i] : offs[i + 1] - 2], minlength=BUCKETS)
        yield batch_of(pa.schema([("lang", pa.string()), ("counts", pa.binary())]), list(totals), [x.tobytes() for x in totals.values()])

    rows = training.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, counts binary")
    found = sorted((r["lang"], np.frombuffer(r["counts"], np.int64)) for r in tree_sum(rows, ["lang"], "counts", "int64").toLocalIterator())
    if len(found) * BUCKETS * 8 > MODEL_LIMIT_MB << 20:
        raise ValueError(f"{len(found)} languages make a model over {MODEL_LIMIT_MB} MB")
    if not found:
        return [], np.zeros((0, BUCKETS))
    counts = np.array([x for _, x in found], float) + 0.5
    return [x for x, _ in found], np.log(counts / counts.sum(1, keepdims=True))


def mixtures(log_p: np.ndarray, gram: np.ndarray, count: np.ndarray, starts: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [text, language] after the choice of each text's set, and the set as booleans.
    ``starts``: where each text's distinct grams begin; every text has some."""
    texts, langs = len(starts), len(log_p)
    p = np.exp(log_p)[:, gram].astype(np.float32)
    count = count.astype(np.float32)
    lengths = np.diff(np.concatenate((starts, [len(gram)])))
    doc = np.repeat(np.arange(texts), lengths)
    total = np.add.reduceat(count, starts)

    def em(theta: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        for step in range(steps + 1):
            blend = np.zeros(len(gram), np.float32)
            for j in range(langs):
                blend += theta[doc, j].astype(np.float32) * p[j]
            if step == steps:
                return theta, np.add.reduceat(count * np.log(blend + 1e-30), starts)
            ratio = count / (blend + 1e-30)
            theta = np.stack([theta[:, j] * np.add.reduceat(ratio * p[j], starts) / total for j in range(langs)], 1)
        raise AssertionError

    theta, fit = em(np.full((texts, langs), 1 / max(1, langs)), rounds)
    kept = np.ones((texts, langs), bool)
    open_ = np.ones(texts, bool)
    for _ in range(langs - 1):
        least = np.where(kept, theta, np.inf).argmin(1)
        tried = kept.copy()
        tried[np.arange(texts), least] &= ~open_
        start = np.where(tried, np.maximum(theta, 1e-6), 0)
        new, new_fit = em(start / start.sum(1, keepdims=True), 3)
        better = open_ & (fit - new_fit < 0.5 * PENALTY * np.log(np.maximum(total, 2)))
        theta, fit, kept = np.where(better[:, None], new, theta), np.where(better, new_fit, fit), np.where(better[:, None], tried, kept)
        open_ = better & (kept.sum(1) > 1)
        if not open_.any():
            break
    theta = np.where(kept, theta, 0)
    return theta / theta.sum(1, keepdims=True), kept


def has_letter(data: np.ndarray, offs: np.ndarray, texts: pa.Array) -> np.ndarray:
    seen = np.concatenate(([0], np.cumsum(_LETTER[data])))
    out = seen[offs[1:]] > seen[offs[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return out


OUT = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("lang_set", pa.string())])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` (any columns with ``text``) with lang_pred (the language of the
    largest proportion), score (that proportion), lang_set (the chosen set, largest first).
    A null text, a text without letters and a model without languages give ``und`` and 0."""
    langs, log_p = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, log_p))

    def run(batch):
        names, log_model = shared.value
        for part in slices(batch, "text"):
            texts = column(part, "text")
            data, offs = flat(texts)
            pred, score, sets = ["und"] * part.num_rows, np.zeros(part.num_rows), [""] * part.num_rows
            rows = [i for i in np.flatnonzero(has_letter(data, offs, texts))] if names else []
            if rows:
                gram, count, starts, at = [], [], [], 0
                for i in rows:
                    own = data[offs[i] : offs[i + 1]]
                    # white space on both sides: a text of one or two bytes has grams too
                    own = grams(np.concatenate(([32], own, [32]) if len(own) > 1 else ([32, 32], own, [32])).astype(np.uint8))
                    c = np.bincount(own, minlength=BUCKETS)
                    g = np.flatnonzero(c)
                    gram.append(g)
                    count.append(c[g])
                    starts.append(at)
                    at += len(g)
                theta, kept = mixtures(log_model, np.concatenate(gram), np.concatenate(count), np.array(starts))
                for i, t, k in zip(rows, theta, kept, strict=True):
                    order = [int(j) for j in np.argsort(-t, kind="stable") if k[j]]
                    pred[i], score[i], sets[i] = names[order[0]], min(1.0, float(t[order[0]])), "+".join(names[j] for j in order)
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in range(part.num_columns) if part.schema.names[c] != "text"] + batch_of(OUT, pred, score, sets).columns,
                names=[n for n in part.schema.names if n != "text"] + OUT.names,
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return by_batch(docs, run, f"{schema}, lang_pred string, score double, lang_set string")


def held_out():
    """Documents that are never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, lang_set.  A null doc_id is
    not held out.  Repeated rows get equal results; other columns are ignored."""
    rows = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = learn(rows.where(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), model)
