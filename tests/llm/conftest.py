import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    *(T.StructField(c, T.StringType()) for c in ("did", "tk", "marks", "h", "pos", "bucket", "label", "n_removed", "keep", "y", "x", "ids")),
])


@pytest.fixture(scope="session")
def docs(spark):
    """A function from (doc_id, text[, lang]) rows to documents with clashing extra columns."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", None if r[1] is None else len(r[1]), *["x"] * 12) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def words():
    """A function from (seed, n) to n made-up words."""

    stocks = {}

    def make(seed, n, size=400):
        rng = random.Random(seed)
        if size not in stocks:
            stocks[size] = ["".join(random.Random(f"w{i}").choice(["ba", "re", "ti", "no", "su", "lé"]) for _ in range(2 + i % 3)) + str(i) for i in range(size)]
        return [rng.choice(stocks[size]) for _ in range(n)]

    return make


@pytest.fixture(scope="session")
def odd(docs, words):
    """Nulls, empty and space-only texts, repeated rows, equal texts, a very long text."""
    base = ". ".join(" ".join(words(i, 9)) for i in range(6)) + "."
    return docs([
        (1, None), (2, ""), (3, " \n "), (4, base), (4, base), (5, base), (None, base), (None, None), (6, "one"), (7, "One two."),
        (8, "\n".join(" ".join(words(100 + i, 8)) + "." for i in range(6000))), (9, "ä漢😀 ▁x" * 30), (10, None, None),
    ])
