"""SentencePiece encoding and decoding by a max-plus parallel scan.

A BPE encoding is the one path through the lattice of a text's pieces on which every two
neighbours are what BPE makes of their joined text.  So the path is a best path over
(max, +), where a step weighs 0 if the pieces fit and minus infinity if they don't, and
its states at a place are the pieces that end there.

A text is cut into chunks at any place.  The state at a boundary is the first piece
that ends at or after it: (how far after, how long).  A chunk is a transfer matrix from the
states before it to those after it; as all weights are 0 or minus infinity, a row is kept as
the set of states it leads to.  Matrices combine associatively; a forward scan over a text's
matrices gives the states that the text's start can lead to, a backward scan over them the
states on the path, and every chunk is then traced back on its own.  Chunks of a giant text
are dealt out to all tasks, those of other texts stay where the text is read; the steps are
the same.

Inside a chunk, words are independent: pieces have the space mark at their start only, so
that every path has a cut before each run of marks.  Whole words go to the library.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import by_batch, column, long_key, slices, stored, text_key
from .textops import powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk, and of the texts whose chunks are dealt out.
CHUNK, GIANT = 1 << 13, 1 << 16
RESULTS = ("n_chunks", "n_tokens", "round_trip", "ids", "ids_digest")
#: Pairs of pieces that a worker remembers.
MEMORY = 1 << 16
#: A state that stands for the one at the text's end.
END = (-1, -1)

_MARK = "▁"
_CUT = re.compile(rf"(?<=[^{_MARK}]){_MARK}")


class Lattice:
    """Pieces of a BPE model file, and which of them can stand side by side."""

    def __init__(self, path: str) -> None:
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that keep texts as they are can be used")
        if proto.trainer_spec.model_type != 2:
            raise ValueError("only BPE models can be used")
        self.prefix = _MARK if proto.normalizer_spec.add_dummy_prefix else ""
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.pieces: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i, p in enumerate(proto.pieces):
            raw = b""
            if p.type == kinds.NORMAL:
                self.pieces[p.piece] = i
                raw = p.piece.encode()
            elif p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:-1], 16)] = i
                raw = bytes([int(p.piece[3:-1], 16)])
            self.bytes_of.append(raw)
        if any(_MARK in p.lstrip(_MARK) for p in self.pieces):
            raise ValueError("pieces that join words aren't supported")
        if not all(self.byte_ids):
            raise ValueError("the model must have bytes to fall back to")
        self.longest = max(map(len, self.pieces))
        #: what pieces begin with
        self.prefixes = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        proto.normalizer_spec.add_dummy_prefix = False
        self.kernel = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.pairs: dict[tuple[str, str], bool] = {}

    def normal(self, text: str) -> str:
        return self.prefix + text.replace(" ", _MARK) if text else ""

    def ids_of(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        return [self.byte_ids[b] for b in piece.encode()] if found is None else [found]

    def encode(self, text: str, chunk: int = CHUNK) -> tuple[array, int]:
        """Ids of a text by the scan over its chunks, and the number of chunks."""
        parts = cut_chunks(self.normal(text), chunk, self.longest)
        ids = array("i")
        if len(parts) < 2:
            for part in parts:
                ids.extend(self.trace(*part, [(0, 0)], END)[1])
            return ids, 1
        for part, (entry, leave) in zip(parts, states([self.matrix(*x) for x in parts]), strict=True):
            ids.extend(self.trace(*part, [entry], leave)[1])
        return ids, len(parts)

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text.replace(_MARK, " ")[len(self.prefix) :]

    # -- the lattice ----------------------------------------------------------------

    def fits(self, x: str, y: str) -> bool:
        """Whether BPE makes x and y of their joined text."""
        if not x:
            return self.kernel.encode(y) == self.ids_of(y)
        if y[0] == _MARK and x[-1] != _MARK:
            return self.fits("", y)
        key = x, y
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            found = self.pairs[key] = self.kernel.encode(x + y) == self.ids_of(x) + self.ids_of(y)
        return found

    def forward(self, full: str, base: int, entries: list[tuple[int, int]], stop: int) -> dict:
        """All states (place, length) that ``entries`` lead to, with the state before each
        (None: an entry).  Places count from ``base`` in ``full``; pieces start before ``stop``."""
        reached: dict[int, dict[int, tuple[int, int] | None]] = {}
        for at, length in entries:
            reached.setdefault(at, {})[length] = None
        i, end = 0, len(full) - base
        while i < stop:
            here = reached.get(i)
            if here:
                ends = []
                for j in range(i + 1, min(i + self.longest, end) + 1):
                    part = full[base + i : base + j]
                    if part not in self.prefixes:
                        break
                    if part in self.pieces:
                        ends.append(j)
                if not ends or ends[0] != i + 1:
                    ends.insert(0, i + 1)  # a character that isn't a piece stands alone
                for j in ends:
                    piece = full[base + i : base + j]
                    for length in sorted(here, reverse=True):
                        if self.fits(full[base + i - length : base + i] if length else "", piece):
                            reached.setdefault(j, {}).setdefault(j - i, (i, length))
                            break
            i += 1
        return reached

    # -- chunks: (before, s, size) -----------------------------------------------------
    # ``s`` is the chunk's own ``size`` characters, then up to longest - 1 of the next ones;
    # ``before``: up to longest characters before the chunk.

    def first_cut(self, before: str, s: str, size: int) -> int:
        """The first place below ``size`` at which every path has a cut, or -1."""
        if size and s[0] == _MARK and before[-1:] != _MARK:
            return 0
        m = _CUT.search(s, 1, size) if size > 1 else None
        return m.start() if m else -1

    def entries(self, before: str, s: str) -> list[tuple[int, int]]:
        """Every state that the boundary before the chunk could have."""
        if not before:
            return [(0, 0)]
        out = [(0, 1)]
        for a in range(min(self.longest, len(s) + 1)):
            for length in range(a + 1, min(self.longest, a + len(before)) + 1):
                if length > 1 and (before[a - length :] if a < length else "") + s[:a] in self.pieces:
                    out.append((a, length))
        return out

    def last_word(self, s: str, size: int, cut: int) -> int:
        """Where the last word from ``cut`` on starts, which may go on after the chunk; whole words stand before it."""
        last = s.rfind(_MARK, cut, size)
        while last > cut and s[last - 1] == _MARK:
            last -= 1
        return last

    def exits(self, reached: dict, size: int, base: int = 0) -> list[tuple[int, int]]:
        return [(at - size + base, length) for at in sorted(reached) if at + base >= size for length in reached[at] if length > at + base - size or length == 0]

    def matrix(self, before: str, s: str, size: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """The chunk's transfer matrix, by rows: the exits that each entry leads to."""
        cut = self.first_cut(before, s, size)
        rows = self.entries(before, s)
        if cut < 0:
            return {e: self.exits(self.forward(before + s, len(before), [e], size), size) for e in rows}
        last = self.last_word(s, size, cut)
        tail = self.exits(self.forward(s, last, [(0, 0)], size - last), size, last)
        return {e: tail if self.forward((before + s)[: len(before) + cut], len(before), [e], cut).get(cut) else [] for e in rows}

    def trace(self, before: str, s: str, size: int, entries: list, leave: tuple[int, int] | None) -> tuple[dict, array]:
        """With the entries that the text's start leads to: the entry of every exit, and the
        ids on the path to the exit ``leave`` (END: the text's; None: no ids)."""
        cut, ids = self.first_cut(before, s, size), array("i")

        def back_from(reached, full, base, at, length):
            path = []
            while (prior := reached[at][length]) is not None:
                path.append(full[base + at - length : base + at])
                at, length = prior
            return (at, length), [i for p in reversed(path) for i in self.ids_of(p)]

        to = {}
        if cut < 0:
            reached = self.forward(before + s, len(before), entries, size)
            out = self.exits(reached, size)
            leave = last_exit(out) if leave == END else leave
            for e in out:
                to[e], got = back_from(reached, before + s, len(before), e[0] + size, e[1])
                if e == leave:
                    ids.extend(got)
            return to, ids
        last = self.last_word(s, size, cut)
        full = (before + s)[: len(before) + cut]
        head = self.forward(full, len(before), entries, cut)
        tail = self.forward(s, last, [(0, 0)], size - last)
        start, first = back_from(head, full, len(before), cut, max(head[cut]))
        out = self.exits(tail, size, last)
        leave = last_exit(out) if leave == END else leave
        for e in out:
            to[e] = start
            if e == leave:
                ids.extend(first)
                ids.extend(self.kernel.encode(s[cut:last]))
                ids.extend(back_from(tail, s, last, e[0] + size - last, e[1])[1])
        return to, ids


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def times(row: list, matrix: dict) -> list:
    """Row vector times matrix over (max, +)."""
    return sorted({tuple(x) for e in row for x in matrix.get(tuple(e), ())})


def product(x: dict, y: dict) -> dict:
    """Matrix product over (max, +); associative."""
    return {e: times(row, y) for e, row in x.items()}


def states(matrices: list[dict]) -> list[tuple]:
    """(entry, exit) of every chunk on the text's one path: a scan forward over its matrices for
    the states its start leads to, and one backward from its end."""
    entries, at = [], [(0, 0)]
    for m in matrices:
        entries.append(at)
        at = times(at, m)
    leave, out = last_exit(at), []
    for entry, m in zip(reversed(entries), reversed(matrices), strict=True):
        first = next(tuple(e) for e in entry if leave in map(tuple, m.get(tuple(e), ())))
        out.append((first, leave))
        leave = first
    return out[::-1]


def cut_chunks(text: str, chunk: int, reach: int) -> list[tuple[str, str, int]]:
    return [(text[max(0, i - reach) : i], text[i : i + chunk + reach - 1], min(chunk, len(text) - i)) for i in range(0, len(text), chunk)]


def last_exit(to) -> tuple[int, int]:
    """The state at the text's end."""
    return next(tuple(e) for e in sorted(to) if e[0] == 0)


def polynomial(ids: np.ndarray, before: int = 0) -> int:
    """An order-aware digest that adds up over parts: the sum of (id + 1) times a power of its place."""
    if not len(ids):
        return 0
    with np.errstate(over="ignore"):
        at = powers(len(ids))[: len(ids)]
        total = np.sum((ids.astype(np.uint64) + np.uint64(1)) * at, dtype=np.uint64)
    step = int(powers(2)[1])
    return int(total) * pow(step, before, 1 << 64) % (1 << 64)


def _dump(pairs) -> str:
    """States, or a matrix or map as rows of [entry, ...], as text."""
    return json.dumps([[k, v] for k, v in pairs.items()] if isinstance(pairs, dict) else pairs)


def _each(batch, *names):
    """Rows of a batch, one at a time: a batch of chunks may be large."""
    columns = [column(batch, c) for c in names]
    return (tuple(c[i].as_py() for c in columns) for i in range(batch.num_rows))


def _ids_column(packed: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode_texts(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, digest: bool = False, giant: int = GIANT) -> DataFrame:
    """Every row of ``docs`` with, in place of ``text``: n_chunks, n_tokens, round_trip (whether
    the ids decode to the text), and ``ids array<int>``, or with ``digest`` ids_digest, a
    hexadecimal digest of the ids in order.

    All texts are encoded by chunks of ``chunk`` characters; those of texts over ``giant``
    characters are dealt out: matrices, scans over a text's matrices, paths.  A text of 2^31
    bytes, the most a row can hold, has 2^18 matrices in one scan.  Null and empty texts
    have no ids and one chunk.  A text that holds the space mark itself comes back with a space.  Repeated
    rows stay; an empty table stays empty; columns of ``docs`` with the names of results, or did and tk, are replaced."""
    keep = [c for c in docs.columns if c not in ("text", "did", "tk", *RESULTS)]
    rows = docs.select(*keep, "text", long_key().alias("did") if "doc_id" in keep else F.lit(0).cast("long").alias("did"), text_key().alias("tk"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    large = F.coalesce(F.length("text"), F.lit(0)) > giant
    head = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    last = ("ids_digest", "string") if digest else ("ids", "array<int>")
    schema = f"{head}n_chunks int, n_tokens long, round_trip boolean, {last[0]} {last[1]}"

    def whole(batch):
        model_ = lattice(model)
        for part in slices(batch.select([*keep, "text"]), "text", 1 << 20):
            packed, chunks, same = [], [], []
            for (t,) in _each(part, "text"):
                ids, n = model_.encode(t or "", chunk)
                packed.append(ids.tobytes())
                chunks.append(n)
                same.append(model_.decode(ids) == (t or ""))
            made = pa.array([f"{polynomial(np.frombuffer(x, np.int32)):016x}" for x in packed], pa.string()) if digest else _ids_column(packed)
            counts = pa.array([len(x) // 4 for x in packed], pa.int64())
            yield pa.RecordBatch.from_arrays([*(column(part, c) for c in keep), pa.array(chunks, pa.int32()), counts, pa.array(same, pa.bool_()), made], names=[*keep, "n_chunks", "n_tokens", "round_trip", last[0]])

    small = by_batch(rows.where(~large).select(*keep, "text"), whole, schema)

    def cut(batch):
        model_ = lattice(model)
        for did, tk, t in _each(batch, "did", "tk", "text"):
            t = model_.normal(t)
            for i in range(0, len(t), 64 * chunk):  # a batch of 64 chunks
                made = [(t[max(0, j - model_.longest) : j], t[j : j + chunk + model_.longest - 1], min(chunk, len(t) - j)) for j in range(i, min(i + 64 * chunk, len(t)), chunk)]
                n = len(made)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([did] * n, pa.int64()), pa.array([tk] * n, pa.binary()), pa.array(range(i // chunk, i // chunk + n), pa.int32()), *(pa.array(list(x), kind) for x, kind in zip(zip(*made, strict=True), (pa.string(), pa.string(), pa.int32()), strict=True))],
                    names=["did", "tk", "part", "before", "s", "size"],
                )

    keyed = "did long, tk binary, part int"
    large_rows = rows.where(large)
    cuts = by_batch(large_rows.groupBy("did", "tk").agg(F.first("text").alias("text")), cut, f"{keyed}, before string, s string, size int")
    chunks = stored(cuts.repartition("did", "tk", "part"))

    def one_by_one(batch, names, fn, kinds_):
        """Batches of 64 rows: the keys and what ``fn`` makes of the columns ``names``."""
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            made = zip(*(fn(*x) for x in _each(part, *names)), strict=True)
            yield pa.RecordBatch.from_arrays([*(column(part, c) for c in ("did", "tk", "part")), *(pa.array(list(v), k) for v, (_, k) in zip(made, kinds_, strict=True))], names=["did", "tk", "part", *(n for n, _ in kinds_)])

    def matrices(batch):
        model_ = lattice(model)
        yield from one_by_one(batch, ("before", "s", "size"), lambda *x: (_dump(model_.matrix(*x)),), [("m", pa.string())])

    def scan(pdf):
        pdf = pdf.sort_values("part", ignore_index=True)
        found = states([{tuple(k): v for k, v in json.loads(m)} for m in pdf["m"]])
        return pdf[["did", "tk", "part"]].assign(entry=[json.dumps(e) for e, _ in found], leave=[json.dumps(x) for _, x in found])

    between = by_batch(chunks, matrices, f"{keyed}, m string").groupBy("did", "tk").applyInPandas(scan, f"{keyed}, entry string, leave string")

    def path(batch):
        model_ = lattice(model)

        def trace(before, s, size, entry, leave):
            entry, leave = tuple(json.loads(entry)), tuple(json.loads(leave))
            ids = model_.trace(before, s, size, [entry], leave)[1]
            # pieces that start in the chunk, and what they stand for
            span = s[entry[0] : size + leave[0]]
            found = b"".join(map(model_.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
            return len(ids), found == span, polynomial(np.frombuffer(ids, np.int32)) - (1 << 63) if digest else 0, None if digest else ids.tobytes()

        yield from one_by_one(batch, ("before", "s", "size", "entry", "leave"), trace, [("n", pa.int64()), ("same", pa.bool_()), ("value", pa.int64()), ("packed", pa.binary())])

    paths = by_batch(chunks.join(between, ["did", "tk", "part"]), path, f"{keyed}, n long, same boolean, value long, packed binary")
    parts = F.array_sort(F.collect_list(F.struct("part", "n", "same", "value", "packed"))).alias("p")
    joined = paths.groupBy("did", "tk").agg(parts)

    def finish(batch):
        for i in range(0, batch.num_rows, 16):
            part = batch.slice(i, 16)
            chunks_, counts, same, made = [], [], [], []
            for (p,) in _each(part, "p"):
                chunks_.append(len(p))
                counts.append(sum(x["n"] for x in p))
                # the space mark itself comes back as a space
                same.append(all(x["same"] for x in p))
                if digest:
                    total = before = 0
                    for x in p:
                        total += (x["value"] + (1 << 63)) * pow(int(powers(2)[1]), before, 1 << 64)
                        before += x["n"]
                    made.append(f"{total % (1 << 64):016x}")
                else:
                    made.append(b"".join(x["packed"] for x in p))
            values = pa.array(made, pa.string()) if digest else _ids_column(made)
            same = pa.array(same, pa.bool_())
            same = pc.and_(same, column(part, "plain"))
            yield pa.RecordBatch.from_arrays([*(column(part, c) for c in keep), pa.array(chunks_, pa.int32()), pa.array(counts, pa.int64()), same, values], names=[*keep, "n_chunks", "n_tokens", "round_trip", last[0]])

    plain = (~F.contains("text", F.lit(_MARK))).alias("plain")
    found = by_batch(large_rows.select(*keep, "did", "tk", plain).join(joined, ["did", "tk"]).select(*keep, "plain", "p"), finish, schema)
    return small.unionByName(found)


def decode_texts(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Every row with ``text`` decoded from ``ids`` (null: empty), which stay.  A space mark
    that stood in the text itself comes back as a space."""
    names = [c for c in encoded.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "text") + ", text string"

    def run(batch):
        model_ = lattice(model)
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts = [model_.decode(ids or []) for ids in column(part, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(column(part, c) for c in names), pa.array(texts, pa.string())], names=[*names, "text"])

    return by_batch(encoded.select(*names), run, schema)
