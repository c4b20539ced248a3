"""Line runs, sentence spans and near duplicates against brute force."""

import itertools
import random
import re
from collections import Counter

import pytest

from graphloom.llm import line_runs, near_duplicates, sentence_spans
from graphloom.llm.components import components


def brute_lines(rows, k):
    """Later copies of runs of k lines, on rows in order of id."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = text.split("\n") if text else []
        gone = set()
        for a in range(len(lines) - k + 1):
            key = tuple(lines[a : a + k])
            if key in seen:
                gone |= set(range(a, a + k))
            seen.add(key)
        out[i] = (len(lines), len(gone), "\n".join(x for j, x in enumerate(lines) if j not in gone))
    return out


@pytest.mark.parametrize("k", [2, 3])
def test_line_runs(docs, k):
    rng = random.Random(k)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for i in range(40)]
    rows += [(50, "a\n" * 9), (51, "x\ny\nz\n\nw"), (52, "q\nx\ny\nz\n\nw\nr")]
    got = {r["doc_id"]: (r["n_lines"], r["n_deleted"], r["text"]) for r in line_runs.dedup(docs(rows), k).collect()}
    assert got == brute_lines(rows, k)


def test_line_runs_odd(odd, docs):
    out = line_runs.dedup(odd).collect()
    assert len(out) == 13
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] is None and by[1][0]["n_lines"] == 0 and by[2][0]["text"] == ""
    assert [r["text"] for r in by[4]] == [by[4][0]["text"]] * 2 and by[4][0]["n_deleted"] == 0
    assert by[8][0]["n_lines"] == 6000 and by[8][0]["n_deleted"] == 0
    assert line_runs.dedup(docs([])).count() == 0


def test_long_lines(spark, docs, words):
    """A long line is a run alone: between other neighbours, as a whole document, at the start and end."""
    import corpus_pipeline

    long, short = " ".join(words(1, 50)), " ".join(words(2, 49))
    rows = [(1, f"a\n{long}\nb\n{short}"), (2, f"c\n{long}\nd"), (3, long), (4, f"e\n{short}\nf"), (5, short), (6, f"{long}\ng\n{long}"), (7, "a\nh\nb")]
    want = {1: rows[0][1], 2: "c\nd", 4: rows[3][1], 5: short, 6: "g", 7: rows[6][1]}
    got = corpus_pipeline.line_dedup(spark, docs(rows), "").collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(want[r["doc_id"]]) for r in got)
    # the query keeps to runs of two lines, as its SQL does
    assert {r["doc_id"]: r["n_deleted"] for r in line_runs.dedup(docs(rows)).collect()} == dict.fromkeys(range(1, 8), 0)


def test_suffix_ranks_are_places(docs):
    """All ranks together order the suffixes as the ids of their lines do."""
    rows = [(0, "a\nb\na\nb\na"), (1, "b\na\nb\nc"), (2, "c\na\nb\na")]
    final = {}
    for h, table in line_runs.intervals(docs(rows)):
        for r in table.collect():
            final[r["did"], r["pos"]] = r["rank"]
    ids = dict(zip("abc", (int(x) for x in line_ids("abc")), strict=True))
    suffix = {(i, p): [ids[x] for x in t.split("\n")[p:]] for i, t in rows for p in range(len(t.split("\n")))}
    order = sorted(suffix.values())
    assert {k: order.index(s) for k, s in suffix.items()} == final


def line_ids(lines):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([b"k"]), pa.array(["\n".join(lines)])], names=["did", "tk", "text"])
    return [x for b in line_runs._lines(batch) for x in b["line"].to_pylist()]


def brute_spans(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        spots = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\v\f\r]+", text)]
        sents, own, begin = [], [], 0
        for n, (a, b) in enumerate(spots):
            own.append(text[a:b])
            last = n == len(spots) - 1
            if last or text[b - 1] in ".!?,;:" or re.search(r"[\n\r]", text[b : spots[n + 1][0]]):
                end = len(text) if last else spots[n + 1][0]
                sents.append((begin, end, tuple(own)))
                begin, own = end, []
        gone = set()
        for a in range(len(sents)):
            total = 0
            for k in range(1, len(sents) - a + 1):
                total += len(sents[a + k - 1][2])
                if total >= 24:
                    key = tuple(x[2] for x in sents[a : a + k])
                    if key in seen:
                        gone |= set(range(a, a + k))
                    seen.add(key)
                    break
        out[i] = (len(sents), len(gone), "".join(text[a:b] for j, (a, b, _) in enumerate(sents) if j not in gone) if sents else text)
    return out


def test_sentence_spans(docs, words):
    rng = random.Random(3)
    sent = [" ".join(words(i, rng.randint(1, 12))) + rng.choice(".!?,;:") for i in range(40)] + [" ".join(words(99, 60)) + "."]
    rows = [(i, "".join(rng.choice(sent) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    passage = " ".join(sent[:6])
    rows += [(60 + i, f"{words(200 + i, 8)[0]} start.\n{passage}\nEnd {i}.") for i in range(3)]
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["text"]) for r in sentence_spans.dedup(docs(rows)).collect()}
    want = brute_spans(rows)
    assert got == want
    assert passage in got[60][2] and passage not in got[61][2]


def prose(stock, rng, n):
    """Sentences of 3 to 24 words with some commas, ``n`` words or a little more."""
    out = []
    while len(out) < n:
        own = [rng.choice(stock) for _ in range(rng.randint(3, 24))]
        out += [w + "," * (rng.random() < 0.12 and i + 1 < len(own)) for i, w in enumerate(own)]
        out[-1] += rng.choice(".!?")
    return out


def test_sentence_spans_planted(docs, words):
    """Passages of 51 to 90 words that begin and end anywhere, in the middle of other documents'
    sentences: the later copies lose text, documents without a passage lose none."""
    rng = random.Random(11)
    stock, rows, later = words(1, 4000, 3000), [], []
    for g in range(150):
        source, at = prose(stock, rng, 160), rng.randint(0, 60)
        passage = source[at : at + rng.randint(51, 90)]
        for c in range(2):
            own = prose(stock, rng, 120)
            cut = rng.randint(5, 110)
            rows.append((10 * g + c, " ".join(own[:cut] + passage + own[cut:])))
        later.append(10 * g + 1)
        rows.append((10 * g + 5, " ".join(prose(stock, rng, 200))))
    got = {r["doc_id"]: r["n_removed"] for r in sentence_spans.dedup(docs(rows)).collect()}
    assert sum(got[i] > 0 for i in later) / len(later) >= 0.95
    assert not any(got[i] for i in got if i not in later)


def test_sentence_spans_odd(odd, docs):
    by = {}
    for r in sentence_spans.dedup(odd).collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, by.values())) == 13
    assert by[1][0]["text"] is None and by[4][0]["n_removed"] == by[4][1]["n_removed"] == 0
    assert by[5][0]["n_removed"] == by[5][0]["n_sentences"] == 6 and by[5][0]["text"] == ""
    assert sentence_spans.dedup(docs([])).count() == 0


def shingle_bag(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard_p(x, y):
    union = set(x) | set(y)
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in union) for d in set(x) & set(y))


def test_similarity():
    a, b = "a b c d e f g h a b c d e i", "a b c d e f g h i j a b c d e"
    assert near_duplicates.similarity(near_duplicates.bag(a), near_duplicates.bag(b)) == pytest.approx(jaccard_p(shingle_bag(a), shingle_bag(b)))
    assert near_duplicates.similarity(near_duplicates.bag(a), near_duplicates.bag(a)) == pytest.approx(1)


def near_rows(words):
    rng, rows, n = random.Random(5), [], 0
    for g in range(6):
        base = words(g, rng.randint(20, 120))
        for edits in [0, 0, 0, 1, 1, 2, 3, 5, 9]:
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = f"new{n}{rng.random():.3f}"
            rows.append((n, " ".join(own)))
            n += 1
    # a chain: each is near the one before it only
    own = words(77, 60)
    for i in range(8):
        own = [*own[3:], f"c{i}", f"d{i}", f"e{i}"]
        rows.append((n, " ".join(own)))
        n += 1
    return rows


def test_near_duplicates(docs, words):
    rows = near_rows(words)
    bags = {i: shingle_bag(t) for i, t in rows}
    parent = {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(bags), 2):
        if jaccard_p(bags[a], bags[b]) >= 0.8 - 1e-12:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(docs(rows)).collect()}
    assert got == {i: root(i) for i in bags}
    kept = {r["doc_id"] for r in near_duplicates.deduplicate(docs(rows)).collect()}
    assert kept == {root(i) for i in bags}


def test_near_duplicates_large_group(spark, docs, words, monkeypatch):
    """One group of near copies of a text, with links of some pairs only: the classes are those of
    brute force, and the pairs compared grow with the group, not with its square."""
    kept = []
    monkeypatch.setattr(near_duplicates, "stored", lambda df, of=near_duplicates.stored: kept.append(of(df)) or kept[-1])
    compared = {}
    for n in (150, 300, 600):
        rng, base, rows = random.Random(n), words(31, 60), []
        for i in range(n):
            own = list(base)
            for k in range(rng.randint(1, 3)):
                own[rng.randrange(60)] = f"edit{i}x{k}"
            rows.append((i, " ".join(own)))
        bags = [shingle_bag(t) for _, t in rows]
        parent = list(range(n))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in itertools.combinations(range(n), 2):
            shared = len(bags[a].keys() & bags[b].keys())
            if shared >= 0.8 * (len(bags[a]) + len(bags[b]) - shared) - 1e-9:
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
        assert all(max(b.values()) == 1 for b in bags)
        kept.clear()
        got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(docs(rows)).collect()}
        assert got == {i: root(i) for i in range(n)}
        compared[n] = sum(x.count() for x in kept if x.columns == ["a", "b", "similarity"])
    assert compared[300] <= 3 * compared[150] and compared[600] <= 3 * compared[300] and compared[600] < 12 * 600


@pytest.mark.parametrize("union", [15, 60])
def test_near_duplicates_tie(docs, union):
    """A similarity of exactly 0.8 is a link, though its float value is lower; one shingle less is none."""
    own = [f"t{union}x{i}" for i in range(union + 4)]
    shared = union * 4 // 5
    whole, tie, less = " ".join(own), " ".join(own[: shared + 4]), " ".join([f"z{x}" for x in own])
    below = " ".join(less.split()[: shared + 3])
    assert near_duplicates.similarity(near_duplicates.bag(whole), near_duplicates.bag(tie)) < 0.8
    got = near_duplicates.near_duplicates(docs([(1, whole), (2, tie), (3, less), (4, below)])).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_near_duplicates_odd(odd, docs):
    out = near_duplicates.near_duplicates(odd)
    assert out.count() == 13
    by = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    assert by[5]["class_id"] == 4 and by[4]["is_first"] and by[1]["class_id"] == 1 and by[2]["class_id"] == 2
    kept = near_duplicates.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    # wordless rows stay; of the base text's four rows one
    assert ids == sorted([(False, i) for i in (1, 2, 3, 4, 6, 7, 8, 9, 10)] + [(True, 0)])
    assert near_duplicates.near_duplicates(docs([])).count() == 0 and near_duplicates.deduplicate(docs([])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (41, 50), (41, 40), (60, 60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 50: 40, 60: 60}
