"""Benchmark decontamination over a distributed positional inverted index.

1. ``build_index`` stores every word of the training texts as postings. Documents are packed into
   segments of about ``SEGMENT`` words; a segment is one row that holds its sorted terms and, for each,
   the ascending positions in one space that runs through the segment's documents. A few positions
   between two documents stay empty, so that no match can cross from one into the next.
2. ``search`` takes test items in blocks of bounded size, which are broadcast. For each window of an
   item a segment takes the list of its rarest term, less the term's place in the window, as
   candidate starts, and cuts them down by the offset-adjusted lists of the other terms, rarest first.
   With a ``slop`` a term may lie up to that many positions off its place: a proximity match.
3. What returns is one row for each document: merged spans of matched words, and the items found.

Nothing is shuffled for one block of items; a document and its postings never leave their segment.
Terms are 64-bit hashes of words. Tables larger than one block of items cost one more pass over the
index for each further block, and a grouping of the documents' rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotable.llm.hashing import _BYTE, mix, powers, spans, utf8
from echotable.llm.storage import Scratch

#: Words of one segment; a longer text is a segment of its own.
SEGMENT = 1 << 18
#: Empty positions before each document.
GAP = 16
#: Characters of the test items of one block, and candidates that one step expands.
BLOCK, STEP = 1 << 22, 1 << 21
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True

INDEX = "segment long, ids array<long>, words binary, terms binary, counts binary, steps binary"
FOUND = "segment long, nth int, id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>, near_items array<string>"


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word ``[0-9a-z\\x80-]+`` after lower-casing A-Z, and the index of each text's first one (one more at the end)."""
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    gaps = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, gaps)
    value = _BYTE[data[starts[0] :]]
    value[~inside[starts[0] :]] = 0
    value *= powers(int(gaps.max()) + 1)[place]
    return mix(np.add.reduceat(value, starts - starts[0])), np.searchsorted(starts, offsets)


def _segment(number: int, ids: list, counts: list, hashes: list) -> pa.RecordBatch:
    """One row of the index: the postings of some documents, term by term, positions as steps from the one before."""
    count, term = np.concatenate(counts), np.concatenate(hashes)
    gap = np.repeat(np.arange(1, len(count) + 1) * GAP, count)
    order = np.argsort(term, kind="stable")
    term, place = term[order], (np.arange(len(term)) + gap)[order]
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    blobs = (count.astype(np.int32), term[first], np.diff(np.append(first, len(term))).astype(np.int32), step.astype(np.int32))
    arrays = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64()))] + [pa.array([b.tobytes()], pa.binary()) for b in blobs]
    return pa.RecordBatch.from_arrays(arrays, ["segment", "ids", "words", "terms", "counts", "steps"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The stored index of all texts: one row for each segment.

    A null text has no words. Every row is a document of its own, repeated and null ids included. An empty
    table gives an empty index.
    """
    scratch = scratch or Scratch(docs.sparkSession, "decontam")

    def run(batches):
        base, k = TaskContext.get().partitionId() << 32, 0
        ids, counts, hashes, n = [], [], [], 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in spans(offsets, 1 << 19):
                part = offsets[lo : hi + 1]
                h, at = words(data[part[0] : part[-1]], part - part[0])
                if n and n + len(h) > SEGMENT:
                    yield _segment(base + k, ids, counts, hashes)
                    ids, counts, hashes, n, k = [], [], [], 0, k + 1
                ids += batch.column(0)[lo:hi].to_pylist()
                counts.append(np.diff(at))
                hashes.append(h)
                n += len(h)
        if ids:
            yield _segment(base + k, ids, counts, hashes)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return scratch.save(rows.mapInArrow(run, INDEX))


class Windows:
    """Windows of test items: their terms as places in ``terms``, grouped by length."""

    def __init__(self, names: list[str], texts: list[str], n: int):
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        h, at = words(data, offsets)
        self.names = np.array(names, object)
        self.terms, inverse = np.unique(h, return_inverse=True)
        inverse = inverse.astype(np.int32)
        groups: dict[int, list] = {}
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if b > a:
                size = min(n, b - a)
                w = np.lib.stride_tricks.sliding_window_view(inverse[a:b], size)
                groups.setdefault(size, []).append((w, np.full(len(w), i, np.int32)))
        self.groups = [(np.concatenate([w for w, _ in g]), np.concatenate([i for _, i in g])) for g in groups.values()]


def _positions(row: dict, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of the sorted ``terms``: the number of its postings and where they begin; and all their positions in a row."""
    own, count = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.int32)
    step = np.frombuffer(row["steps"], np.int32)
    if not len(own):
        return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
    many = np.where(own[at] == terms, count[at], 0).astype(np.int64)
    begin = np.cumsum(many) - many
    start = (np.cumsum(count.astype(np.int64)) - count)[at]
    pick = np.repeat(start - begin, many) + np.arange(int(many.sum()))
    run = np.cumsum(step[pick].astype(np.int64))
    full = many > 0
    before = np.append(0, run)[begin[full]]
    return many, begin, run - np.repeat(before, many[full])


def _matches(window: np.ndarray, many: np.ndarray, begin: np.ndarray, place: np.ndarray, keys: np.ndarray, slop: int):
    """Yield (window numbers, starts) of matches: each term of the window within ``slop`` of its place.

    ``keys`` are the positions with their term before them, ascending.
    """
    width = 1 << 33
    some = np.flatnonzero(many[window].all(1))
    if not len(some):
        return
    order = np.argsort(many[window[some]], axis=1, kind="stable")
    rare = window[some, order[:, 0]]
    off = np.arange(-slop, slop + 1)
    total = np.cumsum(many[rare] * len(off))
    cuts = np.searchsorted(total, np.arange(STEP, total[-1] + STEP, STEP), "left") + 1
    low = 0
    for high in np.unique(np.minimum(cuts, len(some))).tolist():
        part, r, o = some[low:high], rare[low:high], order[low:high]
        low = high
        n = many[r]
        win = np.repeat(np.arange(len(part)), n)
        at = place[np.repeat(begin[r] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] - o[win, 0]
        if slop:
            win, at = np.repeat(win, len(off)), (at[:, None] + off).ravel()
        for k in range(1, window.shape[1]):
            if not len(win):
                break
            term = window[part[win], o[win, k]].astype(np.int64)
            aim = term * width + (at + o[win, k]) + (1 << 32)
            near = np.searchsorted(keys, aim - slop)
            ok = near < len(keys)
            ok &= keys[np.minimum(near, len(keys) - 1)] <= aim + slop
            win, at = win[ok], at[ok]
        if len(win):
            yield part[win], at


def _searcher(shared, slop: int):
    def one(row: dict) -> pa.RecordBatch:
        q = shared.value
        count = np.frombuffer(row["words"], np.int32).astype(np.int64)
        first = np.cumsum(count) - count + np.arange(1, len(count) + 1) * GAP
        end = int(first[-1] + count[-1]) + 1
        many, begin, place = _positions(row, q.terms)
        keys = np.repeat(np.arange(len(many), dtype=np.int64) << 33, many) + place + (1 << 32)
        change = np.zeros(end + 1, np.int64)
        pairs: list[list] = [[], []]
        for window, item in q.groups:
            for kind, off in enumerate((0, slop) if slop else (0,)):
                for win, at in _matches(window, many, begin, place, keys, off):
                    doc = np.searchsorted(first, at + off, "right") - 1
                    pairs[kind].append(np.unique(doc << 32 | item[win]))
                    if not kind:
                        at = np.unique(at)
                        np.add.at(change, at, 1)
                        np.add.at(change, at + window.shape[1], -1)
        hit = np.cumsum(change) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        owner = np.searchsorted(first, start, "right") - 1
        of = np.searchsorted(owner, np.arange(len(count) + 1)).astype(np.int32)
        inside = pa.StructArray.from_arrays([pa.array((x - first[owner]).astype(np.int32)) for x in (start, stop)], ["start", "end"])

        def names(found: list) -> pa.ListArray:
            pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            cut = np.searchsorted(pair >> 32, np.arange(len(count) + 1)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(cut), pa.array(q.names[pair & 0xFFFFFFFF].tolist(), pa.string()))

        n = len(count)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, row["segment"], np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(row["ids"], pa.int64()), pa.array(count),
                pa.ListArray.from_arrays(pa.array(of), inside), names(pairs[0]), names(pairs[1] if slop else pairs[0]),
            ],
            ["segment", "nth", "id", "n_words", "spans", "items", "near_items"],
        )

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield one({c: batch.column(c)[i].as_py() for c in batch.schema.names})

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """One document's rows of several blocks as one: spans united, item names once."""
    out = []
    for start, end in sorted((s["start"], s["end"]) for spans in pdf.spans for s in spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    first = pdf.iloc[:1].copy()
    first["spans"] = [out]
    for c in ("items", "near_items"):
        first[c] = [sorted({x for names in pdf[c] for x in names})]
    return first


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", n: int = 10, slop: int = 0, block_chars: int = BLOCK) -> DataFrame:
    """``(segment, nth, id, n_words, spans, items, near_items)`` of every document of the index.

    ``spans`` are the maximal runs of words (end exclusive) inside a window of ``n`` consecutive words of some
    item; an item of fewer words is one window. ``items`` are the items with an exact match, and
    ``near_items`` those of which some window has each of its words within ``slop`` positions of its place;
    a position may serve for two words. Items are named by their ids as strings; rows of one id are one item, and rows with a
    null id or no words match nothing. An item that is longer than ``block_chars`` is a block of its own at least.
    """
    if 2 * slop + 1 > GAP:
        raise ValueError(f"a slop of {slop} could reach into the next document")
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("name"), F.col(f"`{item_text}`").cast("string").alias("text")).where("name is not null and text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    found = None
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == b).distinct().collect() if blocks > 1 else rows.distinct().collect()
        part.sort()
        shared = index.sparkSession.sparkContext.broadcast(Windows([r.name for r in part], [r.text for r in part], n))
        one = index.mapInArrow(_searcher(shared, slop), FOUND)
        found = one if found is None else found.unionByName(one)
    return found if blocks == 1 else found.groupBy("segment", "nth").applyInPandas(_merge, FOUND)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 10, slop: int = 2) -> DataFrame:
    """``(id, n_words, n_hit, n_items, items_sha256, contaminated, spans, n_near)`` of every document.

    ``items_sha256`` digests the ids of exactly matching items, sorted as strings and comma-joined; without any
    it is the digest of the empty string. ``n_near`` counts the items with a proximity match. Null and
    wordless texts have no hits; no items: no hits; no documents: no rows.
    """
    found = search(build_index(docs, id_col, text_col), items, n=n, slop=slop)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)
    return found.select(
        "id", "n_words", hit.alias("n_hit"), F.size(F.array_distinct("items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.array_distinct("items")), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        "spans", F.size(F.array_distinct("near_items")).cast("long").alias("n_near"),
    )
