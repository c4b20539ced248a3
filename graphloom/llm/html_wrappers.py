"""HTML extraction by union-free wrappers.

All pages of a host are aligned, one after another, into one union-free regular
expression: where token streams agree they stay, where texts differ there is a text slot,
where tokens repeat a repeated group, where tokens are missing an optional group.  The
streams are nested by their tags first, so that an alignment never crosses an element.
The finished wrapper tells which part of the host's pages is the article: it holds most
of the varying text that isn't links, and none of the furniture.

A wrapper is a list of ``[label, repeated, optional, pages, chars, link chars, kids,
text]``; a text slot has the label ``#``, and as ``text`` the hash of a constant text, or
None once texts differ.
"""

from __future__ import annotations

import bisect
import html as entities
import json
import math
import re
from collections import Counter
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, column, slices, stored

#: Bytes of region plans that may be broadcast; a larger table of them is joined by host.
BROADCAST_LIMIT = 32 << 20
#: Hosts whose wrappers one task holds before it sends them on.
OPEN_HOSTS = 4096
#: Elements nested deeper than this bring their text to the element at this depth.
MAX_DEPTH = 150

# Element names of HTML and the words that sites name furniture with.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe svg canvas object math audio video head title".split())
FURNITURE = frozenset("nav footer aside form button select textarea dialog menu fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section"
    " summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"html", "body"}
SAME_LEVEL = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
NAMES = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner sidebar side menu nav navbar"
    " navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist reply replies respond"
    " discussion disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe"
    " subscription signup login related recommended recommendations share sharing social widget widgets search copyright"
    " toolbar pagination pager skip legal disclaimer".split()
)

#: Words that make a class say what an element has or lacks, not what it is.
ABOUT = frozenset("has have with no not without hide show js".split())
#: Names of what readers wrote.
READERS = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
#: Elements that are furniture however much they hold.
ALWAYS = FURNITURE - {"form", "fieldset"}
#: Pairs of labels that an alignment may tabulate; longer lists are cut at labels that both have once.
TABLE = 1 << 18

# a quote opens a value after = only; possessive, so that a search never goes back
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>", re.S)
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDE = {t: re.compile(rf"</{t}\s*>", re.I) for t in HIDDEN}


def label_of(tag: str, attrs: str) -> str:
    """Tag and the words of its class, id and role; digits go, as they number things."""
    if not attrs.strip():
        return tag
    words = []
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true":
            words.append("hidden")
        elif name == "itemprop":
            words += ["articlebody"] if value.lower() == "articlebody" else []
        else:
            for token in value.split():
                own = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower())
                words += own if ABOUT.isdisjoint(own) else ["".join(own)]
    return f"{tag}.{'.'.join(sorted(set(words)))}" if words else tag


def is_furniture(label: str) -> bool:
    """Whether an element's name or words are those of furniture; html, body and main never are."""
    tag, *words = label.split(".")
    if tag in ("html", "body", "main"):
        return "hidden" in words
    return tag in FURNITURE or tag in HIDDEN or "hidden" in words or not NAMES.isdisjoint(words)


def holds(node: list, tags: tuple[str, ...]) -> bool:
    return any(k[0].split(".", 1)[0] in tags or holds(k, tags) for k in node[6])


def is_frame(node: list, whole: int) -> bool:
    """Whether a wrapper's element that is named like furniture stands around the article: it holds
    half of the host's text, or a fifth and a main heading.  What readers wrote needs a heading."""
    tag, *words = node[0].split(".")
    own = node[4] - node[5]
    if tag in ALWAYS or tag in HIDDEN or "hidden" in words or 5 * own < whole:
        return False
    if not READERS.isdisjoint(words):
        return holds(node, ("h1", "main"))
    return 2 * own >= whole or holds(node, ("h1", "main", "article"))


def parse(page: str) -> list:
    """The page as nested elements ``[label, kids]``; a text is ``["#", text, link chars]``.
    Elements that aren't blocks only bring their text; unclosed ones end with their parent."""
    root = ["", []]
    stack, text, links, anchor, at, size = [root], [], 0, 0, 0, len(page)
    too_deep: dict[str, int] = {}
    unclosed: set[str] = set()
    last = page.rfind(">")

    def flush():
        nonlocal links
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                stack[-1][1].append(["#", joined, min(links, len(joined))])
            text.clear()
        links = 0

    while at < size:
        m = _TOKEN.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        piece = page[at : m.start()] if m else page[at:]
        if not m and (cut := _OPEN.search(piece, piece.rfind(">") + 1)):
            piece = piece[: cut.start()]  # the page ends inside a tag
        if piece:
            text.append(piece)
            links += len(piece.strip()) if anchor else 0
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                anchor = max(0, anchor - 1)
            if tag in BLOCK:
                flush()
                if too_deep.get(tag):
                    too_deep[tag] -= 1
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0].split(".", 1)[0] == tag:
                        del stack[depth:]
                        anchor = 0
                        break
            continue
        if tag in HIDDEN:
            if not m[3].endswith("/"):
                end = None if tag in unclosed else _HIDE[tag].search(page, at)
                if not end:
                    unclosed.add(tag)
                # an unclosed head or title must not swallow the page
                at = end.end() if end else (at if tag in ("head", "title") else size)
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "hr":
            flush()
        elif tag == "a":
            anchor += 1
        if tag not in BLOCK or tag in VOID:
            continue
        flush()
        if tag in ENDS_P and stack[-1][0].split(".", 1)[0] == "p":
            stack.pop()
        if tag in SAME_LEVEL:
            for depth in range(len(stack) - 1, 0, -1):
                above = stack[depth][0].split(".", 1)[0]
                if above in SAME_LEVEL[tag]:
                    break
                if above == tag or {above, tag} <= {"dt", "dd"} or {above, tag} <= {"td", "th"}:
                    del stack[depth:]
                    break
        if len(stack) > MAX_DEPTH:
            too_deep[tag] = too_deep.get(tag, 0) + 1
            continue
        node = [label_of(tag, m[3]), []]
        stack[-1][1].append(node)
        stack.append(node)
    flush()
    return root


def wrap(node: list) -> list:
    """The wrapper of one element: its kids with runs that repeat folded."""
    if node[0] == "#":
        return ["#", 0, 0, 1, len(node[1]), node[2], [], xxhash.xxh3_64_intdigest(node[1])]
    kids = fold([wrap(k) for k in node[1]])
    return [node[0], 0, 0, 1, sum(k[4] for k in kids), sum(k[5] for k in kids), kids, None]


def fold(kids: list) -> list:
    """Runs of equal label sequences of one to three elements become repeated groups."""
    for period in (1, 2, 3):
        out, i = [], 0
        while i < len(kids):
            labels = [k[0] for k in kids[i : i + period]]
            j = i + period
            while len(labels) == period and [k[0] for k in kids[j : j + period]] == labels and (period > 1 or labels != ["#"]):
                j += period
            if j > i + period:
                for p in range(period):
                    same = kids[i + p : j : period]
                    one = same[0]
                    for other in same[1:]:
                        one = merge(one, other)
                    one[1], one[2], one[3] = 1, 0, 1
                    out.append(one)
                i = j
            else:
                out.append(kids[i])
                i += 1
        kids = out
    return kids


def merge(a: list, b: list) -> list:
    """The least general wrapper found for what either matches; both have the same label."""
    text = a[7] if a[7] == b[7] else None
    return [a[0], a[1] | b[1], a[2] | b[2], a[3] + b[3], a[4] + b[4], a[5] + b[5], align(a[6], b[6]), text]


def align(a: list, b: list) -> list:
    """Kids of two wrappers by a longest common subsequence of labels; the rest is optional."""
    if [k[0] for k in a] == [k[0] for k in b]:
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for x, y in [*common(a, b), (len(a), len(b))]:
        # the rest of the first comes before that of the second
        out += [[*k[:2], 1, *k[3:]] for k in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a common subsequence of labels; the longest, if the lists are short."""
    a, b = [k[0] for k in a], [k[0] for k in b]
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            found.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= TABLE:
            found += [(i + x, j + y) for x, y in longest(a[i:n], b[j:m])]
        elif anchors := anchored(a, b, i, n, j, m):
            found += anchors
            for (x, y), (z, w) in zip([(i - 1, j - 1), *anchors], [*anchors, (n, m)], strict=True):
                todo.append((x + 1, z, y + 1, w))
        else:
            # nothing is unique: each label to the next place of its like
            where: dict[str, list[int]] = {}
            for y in range(j, m):
                where.setdefault(b[y], []).append(y)
            for x in range(i, n):
                places = where.get(a[x], [])
                at = bisect.bisect_left(places, j)
                if at < len(places):
                    found.append((x, places[at]))
                    j = places[at] + 1
    return sorted(found)


def longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def anchored(a: list[str], b: list[str], i: int, n: int, j: int, m: int) -> list[tuple[int, int]]:
    """The longest ascending run of pairs of labels that either stretch has once."""
    first, second = Counter(a[i:n]), Counter(b[j:m])
    place = {b[y]: y for y in range(j, m) if second[b[y]] == 1}
    tops, ends, before = [], [], {}
    for x in range(i, n):
        if first[a[x]] == 1 and a[x] in place:
            y = place[a[x]]
            at = bisect.bisect_left(tops, y)
            before[x, y] = ends[at - 1] if at else None
            tops[at : at + 1], ends[at : at + 1] = [y], [(x, y)]
    out, at = [], ends[-1] if ends else None
    while at:
        out.append(at)
        at = before[at]
    return out[::-1]


def expression(wrapper: list) -> str:
    """The wrapper as text, for people: ``( )+`` repeated, ``( )?`` optional, ``#`` slot."""
    inner = "#" if wrapper[0] == "#" and wrapper[7] is None else "text" if wrapper[0] == "#" else f"<{wrapper[0]}>" + "".join(map(expression, wrapper[6])) + "</>"
    return f"({inner})" + "+" * wrapper[1] + "?" * wrapper[2] if wrapper[1] or wrapper[2] else inner


def plan(wrapper: list) -> dict:
    """Where the article is: ``region``, the labels down to it, and ``out``, what inside it
    is furniture: [path, hash of a constant text] or [path, None] for whole elements; ``frames``:
    paths of elements in it that are named like furniture and aren't."""
    text = wrapper[4] - wrapper[5]
    frames: set[int] = set()

    def look(node: list) -> None:
        for k in node[6]:
            if k[0] != "#":
                if is_furniture(k[0]) and is_frame(k, text):
                    frames.add(id(k))
                look(k)

    look(wrapper)

    def furniture(node: list) -> bool:
        return is_furniture(node[0]) and id(node) not in frames

    def mass(node: list, outer: bool) -> int:
        """Characters that could be article: no furniture, no links."""
        if node[0] == "#":
            return max(0, node[4] - node[5])
        if furniture(node) or outer and node[0].split(".", 1)[0] == "header":
            return 0
        return sum(mass(k, outer) for k in node[6])

    named: list[tuple[int, list]] = []

    def find(node: list, path: list) -> None:
        for k in node[6]:
            if k[0] == "#" or furniture(k):
                continue
            tag, *words = k[0].split(".")
            if tag in ("article", "main") or "articlebody" in words:
                named.append((mass(k, False), [*path, k[0]]))
            find(k, [*path, k[0]])

    find(wrapper, [])
    whole = mass(wrapper, True)
    articles = [(w, p) for w, p in named if w and p[-1].split(".")[0] != "main"] or [(w, p) for w, p in named if w]
    if articles and max(articles)[0] >= 0.25 * whole:
        region = max(articles, key=lambda x: (x[0], -len(x[1])))[1]
    else:
        node, region = wrapper, []
        while True:
            inner = [(mass(k, True), k) for k in node[6] if k[0] != "#" and k[0].split(".", 1)[0] not in ("p", "table", "ul", "ol", "dl", "pre", "blockquote") and not re.match(r"h\d", k[0])]
            top = max(inner, key=lambda x: x[0], default=(0, None))
            if top[1] is None or top[1][1] or top[0] < 0.7 * mass(node, True) or top[0] == 0:
                break
            node = top[1]
            region = [*region, node[0]]
    node = wrapper
    for label in region:
        node = next(k for k in node[6] if k[0] == label)
    out: list = []
    free: list = []
    varies = False

    def walk(node: list, path: list) -> None:
        nonlocal varies
        for k in node[6]:
            if k[0] == "#":
                varies |= k[7] is None
                # pages of one kind may share their headings
                heading = path and re.match(r"h\d(\.|\Z)", path[-1])
                if k[7] is not None and k[3] >= 3 and k[3] >= 0.5 * wrapper[3] and not heading:
                    out.append([path, k[7]])
            elif not furniture(k):
                if is_furniture(k[0]):
                    free.append([*path, k[0]])
                if k[5] > 0.6 * k[4] and k[0].split(".")[0] in ("ul", "ol", "div", "section", "table", "dl"):
                    out.append([[*path, k[0]], None])
                else:
                    walk(k, [*path, k[0]])

    walk(node, [])
    if not varies:  # copies of one page: constant texts say nothing
        out = [x for x in out if x[1] is None]
    return {"region": region, "out": out, "frames": free}


def extract(root: list, how: dict | None) -> str:
    """The article's blocks of a parsed page."""
    if how is None:
        how = plan(wrap(root))
    nodes = [root]
    for label in how["region"]:
        nodes = [k for n in nodes for k in n[1] if k[0] == label]
    if not nodes:  # this page isn't like its host's others
        own = plan(wrap(root))
        return extract(root, own) if own["region"] != how["region"] else ""
    gone = {tuple(p) for p, h in how["out"] if h is None}
    constant = {(tuple(p), h) for p, h in how["out"] if h is not None}
    frames = {tuple(p) for p in how["frames"]}
    blocks: list[str] = []
    inside = bool(how["region"])

    def walk(node: list, path: tuple) -> None:
        for k in node[1]:
            if k[0] == "#":
                if not constant or (path, xxhash.xxh3_64_intdigest(k[1])) not in constant:
                    blocks.append(k[1])
                continue
            here = (*path, k[0])
            if (not is_furniture(k[0]) or here in frames) and here not in gone and (inside or k[0].split(".", 1)[0] != "header"):
                walk(k, here)

    for n in nodes:
        walk(n, ())
    return "\n\n".join(blocks)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


_WRAPPERS = pa.schema([("host", pa.string()), ("shard", pa.int32()), ("wrapper", pa.string())])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one wrapper for each host, over all its pages.  Tasks first align
    what they read; a host's partial wrappers are then aligned in two levels, so that a host
    with a third of all pages costs one small row a task."""
    fan = max(2, math.isqrt(max(4, pages.rdd.getNumPartitions())))

    def local(batches):
        from pyspark import TaskContext

        shard, open_ = TaskContext.get().partitionId() % fan, {}

        def send():
            rows = [(h, shard, json.dumps(w)) for h, w in open_.items()]
            open_.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _WRAPPERS, strict=True)], schema=_WRAPPERS)

        for batch in batches:
            for part in slices(batch, "html"):
                for url, page in zip(column(part, "url").to_pylist(), column(part, "html").to_pylist(), strict=True):
                    if page:
                        host, one = host_of(url), wrap(parse(page))
                        open_[host] = merge(open_[host], one) if host in open_ else one
                        if len(open_) >= OPEN_HOSTS:
                            yield send()
        if open_:
            yield send()

    def join(pdf):
        one = None
        for raw in sorted(pdf["wrapper"]):
            one = json.loads(raw) if one is None else merge(one, json.loads(raw))
        return pdf.iloc[:1].assign(wrapper=json.dumps(one))

    schema = "host string, shard int, wrapper string"
    out = pages.select("url", "html").mapInArrow(local, schema).groupBy("host", "shard").applyInPandas(join, schema)
    return out.withColumn("shard", F.lit(0)).groupBy("host", "shard").applyInPandas(join, schema).select("host", "wrapper")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, host of every row of ``pages``: the article's blocks, joined
    by two line ends.  Null, empty and text-free html give an empty text.  Hosts that can't
    be read from the url share one wrapper, under the host ''.  Repeated rows get the same
    result, other columns are ignored.  A page is read whole, however long; an empty table gives
    no rows.  What is nested over MAX_DEPTH deep brings its text to the element at that depth."""

    def plans(pdf):
        return pdf.assign(plan=[json.dumps(plan(json.loads(w))) for w in pdf["wrapper"]])[["host", "plan"]]

    known = stored(wrappers(pages).groupBy("host").applyInPandas(plans, "host string, plan string"))
    small = (known.agg(F.sum(F.length("plan") + F.length("host") + 64)).head()[0] or 0) <= BROADCAST_LIMIT
    schema = "page_id long, url string, text string, n_chars long, host string"
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("host", pa.string())])

    def run(batch, known_plans):
        for part in slices(batch, "html"):
            urls = column(part, "url").to_pylist()
            hosts = [host_of(u) for u in urls]
            given = [known_plans.get(h) for h in hosts] if known_plans is not None else column(part, "plan").to_pylist()
            texts = [extract(parse(page), json.loads(how) if how else None) if page else "" for page, how in zip(column(part, "html").to_pylist(), given, strict=True)]
            arrays = [column(part, "page_id"), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(hosts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    if small:
        shared = rows.sparkSession.sparkContext.broadcast({r["host"]: r["plan"] for r in known.toLocalIterator()})
        return by_batch(rows, lambda b: run(b, shared.value), schema)

    def hosted(batch):
        for part in slices(batch, "html"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([host_of(u) for u in column(part, "url").to_pylist()], pa.string())], names=[*part.schema.names, "host"])

    joined = by_batch(rows, hosted, "page_id long, url string, html string, host string").join(known, "host", "left")
    return by_batch(joined, lambda b: run(b, None), schema)
