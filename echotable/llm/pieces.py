"""SentencePiece encoding by a max-plus parallel scan, and decoding.

A text, spaces written as U+2581 and one put in front, is a lattice: its edges are the vocabulary's
pieces and single characters. Encoding is the best path in the (max, +) semiring. In a unigram model
an edge weighs its score. In a BPE model edges weigh nothing, and one edge may follow another only if
merging their joined text gives back just these two; exactly one path is then left, the one that the
merges lead to, so the same scan serves both.

No piece holds U+2581 after another character, so every path passes the places before a run of them
(hard cuts); between two cuts the best path is remembered by word. A word that is not remembered is cut further,
between each two characters that no piece holds side by side, as no edge but a single character's ends or
starts there otherwise; its parts are remembered too.

A giant text is split into chunks at any character. A state of a boundary is an edge that covers the
character before it. A chunk's transfer matrix holds the best weight from each state of its left
boundary to each of its right one; it depends on the text around the chunk's ends alone where a hard
cut lies between. Neighbouring chunks' matrices are combined in pairs, in as many Spark rounds as halve
the longest text to one; then each pair's common boundary is settled from the outer two, downwards,
and each chunk is traced back by itself. No task holds more than two matrices of a text.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from echotable.llm.storage import Scratch
from echotable.llm.tables import free_names, map_in_arrow

SPACE = "▁"
#: Characters of a chunk; a longer text is giant. Words, and pairs of pieces, that a worker remembers.
CHUNK, WORDS, PAIRS = 32_768, 250_000, 300_000
_NONE = -np.inf
_MATRIX = "row long, chunk int, lefts array<array<int>>, rights array<array<int>>, weights array<double>"
_STATES = "row long, chunk int, left array<int>, right array<int>"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]*")


def pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class _Parts(dict):
    """Packed ids by text between hard cuts; what was not used lately is forgotten."""

    def __init__(self, made):
        self.made, self.older = made, {}

    def __missing__(self, w: str) -> bytes:
        got = self.older.get(w)
        if got is None:
            got = self.made(w)
        if len(self) > WORDS:
            self.older = dict(self)
            self.clear()
        self[w] = got
        return got


class Model:
    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.bpe = proto.trainer_spec.model_type == 2
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = min(self.scores.values()) - 10.0
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with inner spaces are not supported")
        self.bytes_of = [b""] * sp.get_piece_size()
        for p, i in self.ids.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        order = sorted(self.ids, key=lambda p: -self.scores[p])
        self.rank = {p: r for r, p in enumerate(order)}
        #: Pieces whose score is another's too, for which the order of merges isn't the rank alone.
        tied = {s for s, n in Counter(self.scores.values()).items() if n > 1}
        self.tied = {p for p in order if self.scores[p] in tied and len(p) > 1}
        #: Characters that some piece holds side by side; any other two have a hard cut between them.
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.parts = _Parts(lambda part: pack(self.word(part)))
        self.words = _Parts(self._in_parts)  # without the space in front
        self.reach: dict[str, int] = {}  # longest piece by its first three characters
        for p in self.ids:
            if len(p) > 2:
                self.reach[p[:3]] = max(self.reach.get(p[:3], 3), len(p))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, list[str]] = {}

    def merged(self, text: str, least: int = 1) -> list[str]:
        """Pieces of a short text by merging the best-scored pair, the leftmost of equals, until none is left.

        It stops at ``least`` pieces.
        """
        parts = list(text)
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        """Whether an edge with text b may follow one with text a."""
        if not self.bpe or (b[0] == SPACE != a[-1]):
            return True
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            if a in self.tied or b in self.tied or (len(a) > 1 and a not in self.rank) or (len(b) > 1 and b not in self.rank):
                ok = self.merged(a + b) == [a, b]
            else:
                ok = self._stays_apart(a, b)
            self.pairs[a, b] = ok
        return ok

    def _stays_apart(self, a: str, b: str) -> bool:
        """No merge joins the facing parts of a and b before these are whole.

        The later of the two pieces' last merges is undone each time, and the parts that then face
        each other must not have been joined earlier.
        """
        rank, limit = self.rank, len(self.rank) + 1
        while True:
            joined = rank.get(a + b)
            if joined is not None and joined < limit:
                return False
            ra, rb = rank[a] if len(a) > 1 else -1, rank[b] if len(b) > 1 else -1
            if ra > rb:
                limit, a = ra, self._halves(a)[1]
            elif len(b) > 1:
                limit, b = rb + 1, self._halves(b)[0]  # of equal merges the left one is first
            else:
                return True

    def _halves(self, piece: str) -> list[str]:
        """What the last merge of a piece joined."""
        got = self.halves.get(piece)
        if got is None:
            got = self.halves[piece] = self.merged(piece, 2)
        return got

    def weight(self, piece: str) -> float:
        return 0.0 if self.bpe else self.scores.get(piece, self.unknown)

    def edges(self, z: str, at: int) -> list[int]:
        """Ends of the edges that start at ``at``, longest first."""
        ids = self.ids
        return [q for q in range(min(len(z), at + self.longest), at + 1, -1) if z[at:q] in ids] + [at + 1]

    def scan(self, z: str, entry: dict[tuple[int, int], np.ndarray], stop: int) -> tuple[dict, dict]:
        """Best weight vectors of the edges that cover ``stop - 1``, from the edges in ``entry``.

        Also gives each edge's predecessor for each column. Edges are (start, end) in z.
        """
        by_end: dict[int, dict[int, np.ndarray]] = {}
        for (s, t), v in entry.items():
            by_end.setdefault(t, {})[s] = v
        back: dict[tuple[int, int], tuple] = {}
        for p in range(min(by_end), stop):
            heads = by_end.get(p)
            if not heads:
                continue
            for q in self.edges(z, p):
                piece, best, how = z[p:q], None, None
                for s, v in heads.items():
                    if s < p and not self.follows(z[s:p], piece):
                        continue
                    if best is None:
                        best, how = v, np.full(len(v), s)
                    else:
                        better = v > best
                        best, how = np.where(better, v, best), np.where(better, s, how)
                if best is not None:
                    by_end.setdefault(q, {})[p] = best + self.weight(piece)
                    back[p, q] = how
            if p not in (t for _, t in entry):
                del by_end[p]
        return {(s, t): v for t, d in by_end.items() if t >= stop for s, v in d.items() if s < stop}, back

    def trace(self, back: dict, edge: tuple[int, int], column: int, entry) -> list[tuple[int, int]]:
        path = []
        while edge in back and edge not in entry:
            path.append(edge)
            edge = (int(back[edge][column]), edge[0])
        return path[::-1]

    def name(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_ids[b] for b in piece.encode()]

    def word(self, w: str) -> list[int]:
        """Ids of what lies between two hard cuts: a scan of one chunk."""
        if self.bpe:
            return self._one_path(w)
        entry = {(0, 0): np.zeros(1)}
        ends, back = self.scan(w, entry, len(w))
        last = max((e for e in ends if e[1] == len(w)), key=lambda e: ends[e][0])
        return [i for s, t in self.trace(back, last, 0, entry) for i in self.name(w[s:t])]

    def _one_path(self, w: str) -> list[int]:
        """The scan from a single state of a BPE model.

        Each place is reached by one edge at most, so the path is followed depth first, the longest
        edge first; a place that led nowhere is not tried again.
        """
        ids, reach, pairs, follows, n = self.ids, self.reach, self.pairs, self.follows, len(w)
        path, before, at, dead = [], "", 0, None
        q = min(n, reach.get(w[:3], 2))
        while at < n:
            while q > at:
                piece = w[at:q]
                if (piece in ids or q == at + 1) and (dead is None or q not in dead):
                    if not before:
                        break
                    ok = pairs.get((before, piece))
                    if follows(before, piece) if ok is None else ok:
                        break
                q -= 1
            if q > at:
                path.append(piece)
                before, at = piece, q
                q = min(n, at + reach.get(w[at : at + 3], 2))
            else:
                dead = dead or set()
                dead.add(at)
                q = at - 1
                at -= len(path.pop())
                before = path[-1] if path else ""
        try:
            return [ids[piece] for piece in path]
        except KeyError:
            return [i for piece in path for i in self.name(piece)]

    def _in_parts(self, word: str) -> bytes:
        """Packed ids of a space and a word, from those of its parts between hard cuts."""
        z, joined = SPACE + word, self.joined
        cuts = [i for i in range(1, len(z)) if z[i - 1 : i + 1] not in joined]
        if not cuts:
            return pack(self.word(z))
        return b"".join([self.words[z[1 : cuts[0]]], *[self.parts[z[i:j]] for i, j in zip(cuts, [*cuts[1:], len(z)])]])

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text as int32 bytes."""
        if not text:
            return b""
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            # more than one space in front of a word: not remembered
            return self._words_of(escaped(text))
        return b"".join(map(self.words.__getitem__, text.split(" ")))

    def _words_of(self, z: str) -> bytes:
        return b"".join([self.words[w[1:]] if w[0] == SPACE != w[1:2] else pack(self.word(w)) for w in _WORD.findall(z) if w])

    def pieces(self, z: str) -> list[int]:
        """Ids of what lies between two hard cuts in front of spaces."""
        return np.frombuffer(self._words_of(z), np.int32).tolist()

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace").removeprefix(" ")


def escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def _states(m: Model, z: str, c: int) -> list[tuple[int, int]]:
    """Edges of z that cover the character before c; z has a margin around c, or ends or starts there."""
    return [(s, t) for s in range(max(0, c - m.longest), c) for t in m.edges(z, s) if t >= c]


def _cuts(z: str, lo: int, hi: int) -> tuple[int, int] | None:
    """First and last hard cut in [lo, hi], if any."""
    first = next((i for i in range(max(lo, 1), hi + 1) if i < len(z) and z[i] == SPACE != z[i - 1]), None)
    if first is None:
        return None
    return first, next(i for i in range(min(hi, len(z) - 1), first - 1, -1) if z[i] == SPACE != z[i - 1])


def transfer(m: Model, z: str, c0: int, c1: int, start: bool) -> tuple[list, list, np.ndarray]:
    """States left and right of the chunk [c0, c1) of z, and the matrix between them.

    States are given as distances (of start, of end) from their boundary.
    """
    left = [(c0, c0)] if start else _states(m, z, c0)
    eye = np.where(np.eye(len(left), dtype=bool), 0.0, _NONE)
    entry = dict(zip(left, eye))
    cut = _cuts(z, c0 + m.longest, c1 - m.longest)
    if cut is None:
        out, _ = m.scan(z, entry, c1)
    else:
        ends, _ = m.scan(z, entry, cut[0])
        reach = np.max([v for (s, t), v in ends.items() if t == cut[0]], axis=0)
        tail, _ = m.scan(z, {(cut[1], cut[1]): np.zeros(1)}, c1)
        out = {e: reach + v[0] for e, v in tail.items()}  # what lies between is the same for all states
    right = sorted(out)
    return [(c0 - s, t - c0) for s, t in left], [(c1 - s, t - c1) for s, t in right], np.array([out[e] for e in right]).T


def trace_chunk(m: Model, z: str, c0: int, c1: int, left: tuple[int, int], right: tuple[int, int]) -> list[int]:
    """Ids of the edges after the state ``left`` up to the state ``right``."""
    first, last = (c0 - left[0], c0 + left[1]), (c1 - right[0], c1 + right[1])
    entry = {first: np.zeros(1)}
    cut = _cuts(z, c0 + m.longest, c1 - m.longest)
    if cut is None:
        _, back = m.scan(z, entry, c1)
        return [i for s, t in m.trace(back, last, 0, entry) for i in m.name(z[s:t])]
    ends, back = m.scan(z, entry, cut[0])
    at_cut = max((e for e in ends if e[1] == cut[0]), key=lambda e: ends[e][0])
    head = m.trace(back, at_cut, 0, entry)
    entry = {(cut[1], cut[1]): np.zeros(1)}
    _, back = m.scan(z, entry, c1)
    ids = [i for s, t in head for i in m.name(z[s:t])]
    ids += m.pieces(z[cut[0] : cut[1]])
    return ids + [i for s, t in m.trace(back, last, 0, entry) for i in m.name(z[s:t])]


def _split(m_longest: int):
    def run(batches):
        for batch in batches:
            out = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                z = escaped(text)
                for k, c0 in enumerate(range(0, len(z), CHUNK)):
                    lo, c1 = max(0, c0 - m_longest), min(len(z), c0 + CHUNK)
                    out.append((row, k, z[lo : c1 + m_longest], c0 - lo, c1 - lo))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()))], ["row", "chunk", "z", "c0", "c1"])

    return run


def _matrices(path: str):
    def run(pdfs):
        m = model(path)
        for pdf in pdfs:
            made = [transfer(m, z, a, b, k == 0) for z, a, b, k in zip(pdf.z, pdf.c0, pdf.c1, pdf.chunk)]
            yield pd.DataFrame({"row": pdf.row, "chunk": pdf.chunk, "rights": [[list(e) for e in r] for _, r, _ in made], "lefts": [[list(e) for e in x] for x, _, _ in made], "weights": [w.ravel() for *_, w in made]})[
                ["row", "chunk", "lefts", "rights", "weights"]
            ]

    return run


def _matrix(r) -> tuple[list, list, np.ndarray]:
    """Left states, right states and weights of a row."""
    lefts, rights = [tuple(e) for e in r.lefts], [tuple(e) for e in r.rights]
    return lefts, rights, np.asarray(r.weights, float).reshape(len(lefts), len(rights))


def _middle(a, b) -> tuple[np.ndarray, np.ndarray, list]:
    """Weights up to and from the boundary between two chunks, and its states: those that both know."""
    place = {e: i for i, e in enumerate(a[1])}
    both = [e for e in b[0] if e in place]
    known = {e: i for i, e in enumerate(b[0])}
    return a[2][:, [place[e] for e in both]], b[2][[known[e] for e in both]], both


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    """The (max, +) product of two neighbouring chunks' matrices; one without a neighbour stays."""
    pdf = pdf.sort_values("chunk")
    first, last = pdf.iloc[0], pdf.iloc[-1]
    weights = first.weights
    if len(pdf) == 2:
        upto, onward, _ = _middle(_matrix(first), _matrix(last))
        weights = np.array([(row[:, None] + onward).max(0) for row in upto]).ravel()
    return pd.DataFrame({"row": [first.row], "chunk": [first.chunk // 2], "lefts": [first.lefts], "rights": [last.rights], "weights": [weights]})


def _outermost(pdfs):
    """The first and the last state of whole texts: the best that ends with the text."""
    for pdf in pdfs:
        out = []
        for r in pdf.itertuples():
            lefts, rights, w = _matrix(r)
            end = max((i for i, e in enumerate(rights) if e[1] == 0), key=lambda i: w[0, i])
            out.append((r.row, r.chunk, list(lefts[0]), list(rights[end])))
        yield pd.DataFrame(out, columns=["row", "chunk", "left", "right"])


def _inner(pdf: pd.DataFrame) -> pd.DataFrame:
    """The boundary states of one or two chunks, from the states around them."""
    pdf = pdf.sort_values("chunk")
    left, right = list(pdf.left.iloc[0]), list(pdf.right.iloc[0])
    if len(pdf) == 1:
        return pdf.assign(left=[left], right=[right])[["row", "chunk", "left", "right"]]
    a, b = _matrix(pdf.iloc[0]), _matrix(pdf.iloc[1])
    upto, onward, both = _middle(a, b)
    mid = list(both[int((upto[a[0].index(tuple(left))] + onward[:, b[1].index(tuple(right))]).argmax())])
    return pd.DataFrame({"row": pdf.row, "chunk": pdf.chunk, "left": [left, mid], "right": [mid, right]})


def settle(matrices: DataFrame, scratch: Scratch) -> DataFrame:
    """``(row, chunk, left, right)``: the states at every chunk's ends on the best path of its text."""
    levels = [scratch.save(matrices)]
    chunks = (levels[0].agg(F.max("chunk")).first()[0] or 0) + 1
    pair = F.expr("chunk div 2").alias("pair")
    while chunks > 1:
        levels.append(scratch.save(levels[-1].groupBy("row", pair).applyInPandas(_combine, _MATRIX)))
        chunks = -(-chunks // 2)
    states = levels.pop().mapInPandas(_outermost, _STATES)
    while levels:
        states = scratch.save(states)
        around = states.select("row", F.col("chunk").alias("pair"), "left", "right")
        met = levels.pop().withColumn("pair", F.expr("chunk div 2").cast("int")).join(around, ["row", "pair"])
        states = met.groupBy("row", "pair").applyInPandas(_inner, _STATES)
    return states


def _trace_all(path: str):
    def run(pdfs):
        m = model(path)
        for pdf in pdfs:
            ids = [trace_chunk(m, z, a, b, tuple(x), tuple(y)) for z, a, b, x, y in zip(pdf.z, pdf.c0, pdf.c1, pdf.left, pdf.right)]
            yield pd.DataFrame({"row": pdf.row, "chunk": pdf.chunk, "ids": ids})

    return run


def _add_ids(path: str, column: int):
    def run(batch):
        m = model(path)
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            ids = [m.packed(t) for t in part.column(column).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]) // 4
            flat = np.frombuffer(b"".join(ids), np.int32)
            yield [*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]

    return run


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (a column of that name is replaced). A null or empty text has no ids.

    Rows are encoded one by one: repeated rows get equal ids, and an empty table gives none.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    keep = [c for c in docs.columns if c != "ids"]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    size = F.coalesce(F.char_length(text_col), F.lit(0))
    short = rows.where(size <= CHUNK)
    done = map_in_arrow(short, _add_ids(path, keep.index(text_col)), [("ids", "array<int>")])

    scratch = Scratch(docs.sparkSession, "pieces")
    (number, found) = free_names(rows, "row", "ids")
    giant = scratch.save(rows.where(size > CHUNK).withColumn(number, F.monotonically_increasing_id()))
    longest = model(path).longest
    chunks = giant.select(F.col(number).alias("row"), text_col).mapInArrow(_split(longest), "row long, chunk int, z string, c0 int, c1 int")
    chunks = scratch.save(chunks.repartition("row", "chunk"))
    settled = settle(chunks.mapInPandas(_matrices(path), _MATRIX), scratch)
    traced = chunks.join(settled, ["row", "chunk"]).mapInPandas(_trace_all(path), "row long, chunk int, ids array<int>")
    whole = traced.groupBy(F.col("row").alias(number)).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x.ids)).alias(found))
    return done.unionAll(giant.join(whole, number).select(*[F.col(f"`{c}`") for c in keep], F.col(found).alias("ids")))


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``rows`` with ``decoded``, the text of ``ids_col`` (a column of that name is replaced); null ids give an empty text."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    keep = [c for c in rows.columns if c != "decoded"]
    frame, column = rows.select(*[F.col(f"`{c}`") for c in keep]), keep.index(ids_col)

    def run(batch):
        m = model(path)
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            yield [*part.columns, pa.array([m.decode(x or ()) for x in part.column(column).to_pylist()], pa.string())]

    return map_in_arrow(frame, run, [("decoded", "string")])
