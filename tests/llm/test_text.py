"""Token counts, extraction, fingerprints, languages, encoding, decontamination, quality."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from graphloom.llm import cotraining, decontamination, fingerprints, html_wrappers, language_id, max_plus, token_counts


def test_token_tree():
    encode = token_counts.encoding(token_counts.VOCABULARY).encode_ordinary
    rng = random.Random(1)
    stock = ["word ", "é", " ", "\n\n", "  x", "it's ", "漢字", "12 ", ".", "Then\t", "!? "]
    for _ in range(60):
        text = "".join(rng.choice(stock) for _ in range(rng.randint(0, 900)))
        tree = token_counts.TokenTree(text, lambda s: len(encode(s)))
        assert tree.total == len(encode(text))
        for _ in range(6):
            a = rng.randint(-2, len(text) + 3)
            b, new = a + rng.randint(-1, 40), "".join(rng.choice(stock) for _ in range(rng.randint(0, 6)))
            tree.edit(a, b, new)
            a = min(max(a, 0), len(text))
            text = text[:a] + new + text[min(max(b, a), len(text)) :]
            assert tree.text() == text and tree.total == len(encode(text)) and tree.chars[1] == len(text)


def test_token_counts_odd(odd, docs):
    rows = token_counts.token_counts(odd.withColumn("edits", token_counts.sample_edits())).collect()
    assert len(rows) == 13 and all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (1, 2))
    none = token_counts.token_counts(odd.withColumn("edits", F.lit(None).cast("array<struct<start:long,stop:long,text:string>>")))
    assert none.where("n_tokens <> edited_tokens or reencoded_chars > 0").count() == 0


def page(i, body, side="<aside class='side-bar'>Top ten</aside>"):
    return f"<!doctype html><html><head><title>t{i}</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>{side}{body}<div id=comments><p>Nice post {i}, I liked it a lot indeed</p></div><footer>&copy; {i}</footer></body></html>"


def test_html(spark):
    pages = [(i, f"http://h.org/{i}", page(i, f"<div class=content><h1>Head {i}</h1><p>First &amp; <b>bold</b>\n text of page {i}.<p>Second para {i * 7} is here, with some words.</div>")) for i in range(5)]
    pages += [(10 + i, f"http://a.org/{i}", page(i, f"<article><h1>Title {i}</h1><p>Body {i} &eacute;x<br>line</p><form><p>Sign up</p></form><p>Share this page</p></article>")) for i in range(4)]
    pages += [(20, None, "plain words only"), (21, "http://x.org", None), (22, "http://x.org", ""), (23, "::bad::", "<p>unclosed <i>par"), (24, "http://deep.org", "<div>" * 3000 + "deep text" + "</div>" * 3000), (24, "http://deep.org", "<div>" * 3000 + "deep text" + "</div>" * 3000), (None, "http://y.org/[", "<script>x<p>no</p></script><p>yes &lt;b&gt;</p><!-- no")]
    table = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in html_wrappers.main_texts(table).collect()}
    for i in range(5):
        assert got[i]["text"] == f"Head {i}\n\nFirst & bold text of page {i}.\n\nSecond para {i * 7} is here, with some words."
    for i in range(4):
        assert got[10 + i]["text"] == f"Title {i}\n\nBody {i} éx line"
    assert got[20]["text"] == "plain words only" and got[21]["text"] == got[22]["text"] == ""
    assert got[23]["text"] == "unclosed par" and got[24]["text"] == "deep text" and got[None]["text"] == "yes <b>"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_wrappers.main_texts(table.limit(0)).count() == 0


ARTICLE = "<h1>Head</h1><p>First para of the article, it is long enough.</p><p>The second isn't lost.</p>"
BLOCKS = "Head\n\nFirst para of the article, it is long enough.\n\nThe second isn't lost."
AROUND = "<div class=sidebar><p>Top ten stories</p></div><div id=comments><p>Nice post</p></div>"


@pytest.mark.parametrize("html", [
    f"<html><body class='single has-sidebar'>{ARTICLE}{AROUND}</body></html>",
    f"<html class='js no-search'><body>{ARTICLE}{AROUND}</body></html>",
    f"<body><div id='main' class='with-sidebar'>{ARTICLE}</div>{AROUND}</body>",
    f"<body><div class='sidebar page'>{ARTICLE}</div>{AROUND}</body>",
    f"<body><form id='aspnetForm' action=x><input name=q>{ARTICLE}{AROUND}</form></body>",
    f"<body><form class=search><input></form><form action=x>{ARTICLE}</form>{AROUND}</body>",
    f"<body>{ARTICLE.replace('<p>First', '<p title=it' + chr(39) + 's>First')}{AROUND}</body>",
    f"<body>{ARTICLE.replace('<p>First', '<p title=a' + chr(34) + '>First')}{AROUND}</body>",
])
def test_html_frames(html):
    """What is named like furniture and stands around the article isn't furniture; stray quotes swallow nothing."""
    assert html_wrappers.extract(html_wrappers.parse(html), None) == BLOCKS


def test_html_shared_headings(spark):
    pages = [(i, f"http://h.org/{i}", f"<body><nav><a href=x>Home page</a></nav><div class=post><h1>Weekly report</h1><p>Text {i} of this week's report.</p><h2>Summary</h2><p>{i * 7} things were done.</p></div></body>") for i in range(5)]
    rows = html_wrappers.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {i: f"Weekly report\n\nText {i} of this week's report.\n\nSummary\n\n{i * 7} things were done." for i in range(5)}


def test_html_blocks(spark, words):
    """Hosts with frames, menus and notices of their own: every block of an article comes out, and nothing else."""
    rng, stock, pages, want = random.Random(12), words(1, 4000, 3000), [], {}
    some = lambda n: " ".join(rng.choice(stock) for _ in range(n))
    frames = ["<div class=content>{}</div>", "<main>{}</main>", "<article>{}</article>", "<div id=page class='has-sidebar'><div class=post>{}</div></div>", "<form id=f><div class=body>{}</div></form>", "<table><tr><td>{}</td></tr></table>"]
    outer = ["<header><p>Site {h}</p></header>", "<nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>", "<div class=banner>Buy {h} now</div>", "<aside><h3>Top</h3><p>{w}</p></aside>"]
    below = ["<div class='comments'><p>{w}</p><p>{w}</p></div>", "<div class=related><ul><li><a href=q>{w}</a></ul></div>", "<footer>Terms of {h}</footer>", "<script>var x = '<p>no</p>';</script>", "<div class='cookie-notice'>We use cookies</div>"]
    for h in range(6):
        before, after = rng.sample(outer, 3), rng.sample(below, 4)
        for i in range(6):
            key = 100 * h + i
            blocks, parts = [], []
            for _ in range(rng.randint(4, 9)):
                text = some(rng.randint(8, 30))
                kind = rng.choice(["p", "p", "p", "h2", "blockquote", "li", "pre"])
                mark = text.replace(" ", " <b>", 1).replace(" ", "</b>\n ", 2).replace("</b>", "", 1) if kind == "p" else text
                parts.append(f"<ul><li>{text}</ul>" if kind == "li" else f"<{kind}>{mark.replace('&', '&amp;')}</{kind}>")
                blocks.append(text)
            fill = lambda x, h=h: x.format(h=f"host{h}", w=some(6))
            pages.append((key, f"http://h{h}.org/{i}", f"<html><head><title>x</title></head><body>{''.join(map(fill, before))}{frames[h].format(''.join(parts))}{''.join(map(fill, after))}</body></html>"))
            want[key] = "\n\n".join(blocks)
    rows = html_wrappers.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in rows} == want


def test_html_is_linear():
    """Stray quotes, open tags and many unlike siblings take no quadratic time or table."""
    begun = time.process_time()
    for page in ("<p title=it's>x</p>'\"" * 20000, "<a <b " * 20000, "<title>" * 20000, "<a b=\"c>" * 20000):
        html_wrappers.parse(page)
    rng = random.Random(3)
    many = [[[f"p.{rng.choice('abcdef')}" if rng.random() < 0.9 else f"p.u{rng.randrange(9999)}", 0, 0, 1, 1, 0, [], None] for _ in range(20000)] for _ in range(2)]
    both = html_wrappers.align(*many)
    assert sum(k[3] for k in both) == 40000 and time.process_time() - begun < 30


def test_wrapper_expression():
    one = html_wrappers.wrap(html_wrappers.parse("<div><p>a<p>b</div><footer>f</footer>"))
    two = html_wrappers.wrap(html_wrappers.parse("<div><p>c</div><table><tr><td>x</table><footer>f</footer>"))
    both = html_wrappers.expression(html_wrappers.merge(one, two))
    assert both == "<><div>(<p>#</>)+</>(<table><tr><td>text</></></>)?<footer>text</></>"


def test_fingerprints(spark, odd, docs, words):
    rows = [(i * 3, " ".join(words(i, 5 + 17 * (i % 9)))) for i in range(60)]
    rows[5] = (15, "")
    rows[6] = (18, rows[9][1])
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs(rows).repartition(7)).collect()}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, new, far = (fingerprints.digest(x.encode()) for x in (text, edited, after))
        assert r["fingerprint"] == fingerprints.encode(own) and r["edited_fingerprint"] == fingerprints.encode(new)
        assert (fingerprints.decode(r["fingerprint"]) == own).all()
        assert r["near_edited"] == pytest.approx(fingerprints.likeness(own, new)) and r["near_next"] == pytest.approx(fingerprints.likeness(own, far))
        assert 0 <= r["near_next"] <= 1
    assert got[18]["fingerprint"] == got[27]["fingerprint"]
    assert fingerprints.fingerprints(odd).count() == 13 and fingerprints.fingerprints(docs([])).count() == 0
    alone = fingerprints.fingerprints(docs([(1, "abcd")])).head()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_language_id(docs, odd):
    stock = {"aa": ["bal", "tor", "min", "sek"], "bb": ["ouv", "ich", "fra", "lle"]}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(stock[lang]) + rng.choice(stock[lang]) for _ in range(30)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    out = {r["doc_id"]: r for r in language_id.language_id(docs(rows)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    assert all(out[i]["lang_pred"] == lang and 0 < out[i]["score"] <= 1 for i, _, lang in rows)
    model = language_id.learn(docs(rows))
    both = language_id.predict(docs([(1, rows[0][1] + " " + rows[1][1]), (2, None), (3, "12 34."), (4, "ба")]).select("doc_id", "text"), model)
    got = {r["doc_id"]: r for r in both.collect()}
    assert got[1]["lang_set"] in ("aa+bb", "bb+aa") and 0.4 < got[1]["score"] < 0.6
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[2]["score"] == 0 and got[4]["lang_pred"] in stock
    assert language_id.language_id(odd).count() == 13 and language_id.language_id(docs([])).count() == 0


def chunked(model, text, chunk):
    parts = max_plus.cut_chunks(model.normal(text), chunk, model.longest)
    rows, entries = [model.matrix(*p) for p in parts], []
    at = [(0, 0)]
    for m in rows:
        entries.append(at)
        at = max_plus.times(at, m)
    # the scan is associative
    whole = rows[0]
    for m in rows[1:]:
        whole = max_plus.product(whole, m)
    assert max_plus.times([(0, 0)], whole) == at
    backs = [model.trace(*p, e, None)[0] for p, e in zip(parts, entries, strict=True)]
    leave, out = None, []
    for back in reversed(backs):
        leave = leave or max_plus.last_exit(back)
        out.append(leave)
        leave = back[leave]
    return [i for p, e, x in zip(parts, entries, out[::-1], strict=True) for i in model.trace(*p, e, x)[1]]


def test_max_plus_is_the_library():
    model = max_plus.lattice(max_plus.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=max_plus.MODEL)
    rng = random.Random(4)
    stock = ["the ", "a", "ing", "   ", "\n", "é", "漢", "tion", " ", "€", "xxqz", "<s>"]
    for _ in range(80):
        text = "".join(rng.choice(stock) for _ in range(rng.randint(1, 70)))
        want = library.encode(text)
        assert list(model.encode(text)[0]) == want and model.decode(want) == text
        for chunk in (16, 19, 33):
            assert chunked(model, text, chunk) == want
            ids, n = model.encode(text, chunk)
            assert list(ids) == want and n == len(max_plus.cut_chunks(model.normal(text), chunk, model.longest))


@pytest.mark.parametrize("giant", [0, 100, 1 << 20])
def test_encoding_of_texts(spark, docs, odd, words, giant):
    """The library's ids, whether chunks stay with their text or are dealt out."""
    library = sentencepiece.SentencePieceProcessor(model_file=max_plus.MODEL)
    rows = [(1, " ".join(words(1, 300))), (1, " ".join(words(1, 300))), (2, "x" * 500), (3, "short"), (4, None), (None, " ".join(words(2, 99))), (5, "é▁" * 90)]
    out = max_plus.encode_texts(docs(rows), chunk=100, giant=giant)
    got = out.select("doc_id", "ids", "n_chunks", "n_tokens", "round_trip").collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((i, tuple(library.encode(t or ""))) for i, t in rows)
    assert all(r["round_trip"] == (r["doc_id"] != 5) and r["n_tokens"] == len(r["ids"]) for r in got) and max(r["n_chunks"] for r in got) > 10
    texts = max_plus.decode_texts(out).select("doc_id", "text").collect()
    assert Counter(map(tuple, texts)) == Counter((i, (t or "").replace("▁", " ")) for i, t in rows)
    digest = max_plus.encode_texts(docs(rows[:1]), chunk=100, digest=True, giant=giant).head()
    assert digest["ids_digest"] == f"{max_plus.polynomial(np.array(library.encode(rows[0][1]), np.int32)):016x}"
    assert max_plus.encode_texts(odd, giant=giant).count() == 13 and max_plus.encode_texts(docs([]), giant=giant).count() == 0


def test_decontamination(spark, docs, words):
    rng = random.Random(6)
    items = [(j, " ".join(words(500 + j, n))) for j, n in enumerate((1, 3, 5, 9, 20, 20, 33, 60))] + [(90, None), (91, "")]
    rows = []
    for i in range(60):
        own = words(i, rng.randint(0, 150), 2000)
        item = items[i % 8][1].split()
        for _ in range(rng.randint(0, 2)):
            item[rng.randrange(len(item))] = f"edit{i}"
        at = rng.randint(0, len(own))
        rows.append((i, " ".join(own[:at] + item[: len(item) - rng.randint(0, 1)] + own[at:])))
    rows += [(100, None), (101, ""), (102, items[6][1]), (103, " ".join(items[7][1].split()[:55]))]

    def bag(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])

    want = {}
    for i, text in rows:
        w = (text or "").split()
        for j, item in items:
            goal = (item or "").split()
            n = min(len(goal), len(w))
            if goal and n and (len(goal) >= 5 or len(w) >= len(goal)) and (n >= 5 or n == len(goal)):
                best = 0.0
                for a in range(len(w) - n + 1):
                    x, y = bag(w[a : a + n]), bag(goal)
                    best = max(best, sum((x & y).values()) / sum((x | y).values()))
                if best >= 0.8:
                    want[i, j] = round(best, 9)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find(docs(rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in found} == want
    blocks = decontamination.find(docs(rows), bench, limit=60).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, found))
    kept = {r["doc_id"] for r in decontamination.clean(docs(rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}
    assert decontamination.find(docs([]), bench).count() == 0 and decontamination.find(docs(rows), bench.limit(0)).count() == 0
    assert decontamination.clean(docs(rows), bench.limit(0)).count() == len(rows)


def test_decontamination_index(words):
    """Unrelated fingerprints hardly ever get past the blocks; all within the radius do."""
    stock, rng = words(1, 4000, 3000), random.Random(5)
    texts = pa.array([" ".join(rng.choice(stock) for _ in range(40)) for _ in range(400)], pa.large_string())
    index = decontamination.Index([(i, t.as_py()) for i, t in enumerate(texts)])
    x, y = index.prints[:200], index.prints[200:]
    i, _, _ = decontamination.near_blocks(x, y)
    assert len(i) < 0.05 * len(x) * len(y)
    rng = np.random.default_rng(1)
    bits = np.unpackbits(x, axis=1)
    for row in bits:
        row[rng.choice(decontamination.BITS, decontamination.RADIUS, replace=False)] ^= 1
    i, j, d = decontamination.near_blocks(np.packbits(bits, axis=1), x)
    assert {(k, k) for k in range(200)} <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert all(d[i == j].sum(1) == decontamination.RADIUS)


def test_decontamination_hot(docs, spark, words, monkeypatch):
    """A shingle that all items share, in every document, in small pieces; items of one shared text."""
    monkeypatch.setattr(decontamination, "HITS", 16)
    same = " ".join(words(1, 12))
    items = [(i, f"{same} {' '.join(words(50 + i, 20))}") for i in range(30)] + [(100 + i, f"{same} {words(7, 9)[i]}") for i in range(6)]
    rows = [(i, f"{' '.join(words(900 + i, 30))} {items[i % 36][1]} {same}") for i in range(40)] + [(99, same)]
    table = docs([r for r in rows]).withColumn("item_id", F.lit("x")).withColumn("similarity", F.lit("x"))
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found >= {(i, items[i % 36][0]) for i in range(40)} and all(d == 99 or j >= 100 or d % 36 == j for d, j in found)


def test_quality(spark, docs, odd, words):
    rng = random.Random(8)
    good = [" ".join(words(i, rng.randint(20, 60))).capitalize() + "." for i in range(150)]
    bad = [" | ".join(words(1000 + i, rng.randint(20, 60))) for i in range(50)] + [f"{w} " * 80 for w in words(9, 30)]
    rows = list(enumerate(good + bad))
    labels = spark.createDataFrame([(i, int(i < 150), 0, "z") for i, _ in rows if i % 2] + [(None, 1, 0, "z"), (0, 0, 0, "z"), (0, 1, 0, "z")], "doc_id long, quality int, toxic int, y string")
    got = {r["doc_id"]: r for r in cotraining.classify(docs(rows), labels).collect()}
    right = [got[i]["keep"] == (i < 150) for i, _ in rows if i % 2 == 0]
    assert sum(right) / len(right) > 0.93 and all(0 <= r["quality_score"] <= 1 for r in got.values())
    none = cotraining.classify(odd, labels.limit(0))
    assert none.count() == 13 and none.where("not keep or quality_score is not null").count() == 0
    assert cotraining.classify(docs([]), labels).count() == 0
    bounded = cotraining.sampled_labels(labels, "quality", 40).count()
    assert 10 < bounded < 80


def test_features_have_no_nan():
    part = pa.RecordBatch.from_arrays([pa.array([None, "", "a", "é\n\n!"]), pa.array([None] * 4, pa.string()), pa.array([None] * 4, pa.string())], names=["text", "source", "lang"])
    assert all(np.isfinite(v).all() for v in cotraining.features(part))
