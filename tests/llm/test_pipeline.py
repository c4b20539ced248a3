"""The corpus pipeline's stages on odd rows, and the whole of it on planted cases."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from graphloom.llm import common, cotraining, decontamination, line_runs, max_plus, near_duplicates, textops

WANT = {"quality_classifier": 13, "line_dedup": 11, "minhash_near_dedup": 10, "benchmark_decontamination": 9, "sentencepiece_encoding": 13}


@pytest.fixture
def tables(spark, tmp_path):
    """A function that writes benchmark texts and labels, and returns their folder."""

    def make(items, labels=()):
        spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return make


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_odd(spark, docs, odd, tables, name, stage):
    """Nulls, empty and very long texts, repeated rows and ties, an empty table, clashing extra columns."""
    base = next(r["text"] for r in odd.where("doc_id = 5").collect())
    sf_dir = tables([(1, base), (2, None), (2, "")])
    out = stage(spark, odd, sf_dir)
    rows = out.collect()
    assert len(rows) == WANT[name]
    if name == "sentencepiece_encoding":
        assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
    else:
        assert out.columns == list(corpus_pipeline.COLUMNS)
        texts = {r["doc_id"]: r["text"] for r in rows}
        assert texts[1] is None and texts[2] == "" and len(texts[8]) > 200_000
    assert stage(spark, docs([]), sf_dir).count() == 0


def test_run(spark, docs, words, tables):
    """Copies, near copies, benchmark passages and repeated long lines go; all else stays whole."""
    one, two, three, four, item = (" ".join(words(i, 120, 3000)) for i in range(5))
    near = one.split()
    near[60] = "other"
    rows = [(1, one), (2, one), (3, " ".join(near)), (4, f"{two}\nown line"), (5, f"before\n{two}\nafter it"), (6, f"{three} {item} {three[::-1]}"), (7, four), (8, None)]
    sf_dir = tables([(1, item)])
    docs(rows).select(*corpus_pipeline.COLUMNS).write.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=max_plus.MODEL)
    want = {1: one, 4: rows[3][1], 5: "before\nafter it", 7: four, 8: ""}
    assert {i: r["ids"] for i, r in got.items()} == {i: library.encode(t) for i, t in want.items()}
    assert all(r["round_trip"] for r in got.values()) and got[5]["n_chars"] == len(want[5])


def test_batches_are_small(spark):
    """A worker gets a few MB at once, not 10,000 rows of any size; a lower limit of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('abcdefgh', 400) as text")
    size = lambda b: [pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]})]
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        got = common.by_batch(rows, size, "rows long, size long").collect()
        assert sum(r["rows"] for r in got) == 4000 and max(r["size"] for r in got) < 1.1 * common.BATCH_BYTES
        spark.conf.set(name, "65536")
        assert max(r["size"] for r in common.by_batch(rows, size, "rows long, size long").collect()) < 100_000
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("step", ["features", "signed", "weighed", "lines", "matches"])
def test_worker_memory(words, step):
    """What a step holds of a batch is bounded, and doesn't grow with the batch."""
    texts = ["\n".join(" ".join(words(40 * i + j, 9)) for j in range(40)) for i in range(1500)]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([b"%016d" % i for i in range(n)]), pa.array(texts), pa.array(["s"] * n), pa.array(["en"] * n)], names=["did", "tk", "text", "source", "lang"])
    assert batch.nbytes > 3 << 20
    index = decontamination.Index([(1, texts[0])])
    run = {
        "features": lambda: (cotraining.features(x) for x in common.slices(batch, "text")),
        "signed": lambda: near_duplicates._signed(batch, ("did", "tk"), near_duplicates.BANDS, near_duplicates.ROWS),
        "weighed": lambda: near_duplicates._weighed(batch),
        "lines": lambda: line_runs._lines(batch, 50),
        "matches": lambda: (index.matches(*common.flat(common.column(x, "text"))) for x in common.slices(batch, "text")),
    }[step]
    tracemalloc.start()
    for _ in run():
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_span_hashes_by_blocks(monkeypatch):
    """Spans' hashes don't depend on the blocks that they are taken in."""
    rng = np.random.default_rng(1)
    values = rng.integers(0, 256, 5000).astype(np.uint8)
    edges = np.sort(rng.integers(0, 5000, 801))
    starts, ends = edges[:-1], np.maximum(edges[:-1], edges[1:] - 1)
    whole = textops.span_hashes(values, starts, ends)
    for n in (1, 7, 300):
        monkeypatch.setattr(textops, "SPAN_VALUES", n)
        assert (textops.span_hashes(values, starts, ends) == whole).all()
    assert [textops.span_hashes(values, starts[i : i + 1], ends[i : i + 1])[0] for i in range(50)] == whole[:50].tolist()
