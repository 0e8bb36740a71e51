"""Exact repeated-passage removal by bucket-pointer refinement over sampled suffixes.

A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller id.

A bucket holds the suffixes that start with the same bytes, and has an identifier. Buckets of twice
the depth come from the identifiers of a suffix and of the suffix that starts where its bucket's bytes
end: the pointer to a later offset. Identifiers are 64-bit hashes of the two they come from, so the
refinement of all suffixes of a text is done in place, and each level's identifiers are the input of
the next: 3, 6, 12 and 24 bytes, then 48, then ``length`` by an overlapping pointer.

1. Initial q-gram buckets: of the 24-byte buckets of every such string one is the string's anchor, that
   of the least identifier (the leftmost of equals). Equal strings have equal anchors at equal offsets,
   so only suffixes that start at anchors need be sorted, about one in fourteen.
2. Anchors are dealt by bucket, packed, and sorted by identifier. A bucket of one document is done. The
   others are refined by the identifiers of a later and of an earlier offset, half of what is missing
   away. An occurrence that shares neither with another document can't be part of a repeat.
3. What is left is refined by the identifiers of the whole stretch of strings that an anchor stands for:
   where a smaller document has the same stretch, all of it goes. Each task does this first for its own
   rows and deals only the smallest document of each stretch, so that a passage that very many
   documents hold reaches its bucket once for each batch.
4. Only the smallest document of each stretch, in buckets of several stretches, still lacks an answer
   for part of it: those stretches are fetched and their strings sorted one by one, by identifier. A bitmap of
   their places tells where they are; where it would be so full that many others pass, each text is joined with its places.

The result is exact up to 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotable.llm.hashing import _SLOT, mix, utf8
from echotable.llm.storage import Scratch

#: Bytes of a q-gram; entries of one bucket; bytes handled at once; bits of the bitmap of stretches.
Q, BUCKET, BLOCK, BITS = 24, 2_000_000, 1 << 20, 27
#: One in so many bits of the bitmap may be set; each other stretch that passes costs several times the text it stands for.
FILL = 32
_rng = np.random.default_rng(50)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.dtype([("id", "<i8"), ("key", "<i8"), ("at", "<u4")])
_ENTRY = np.dtype([("h", "<u4"), ("r", "<u2"), ("l", "<u2"), ("c", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("back", "u1"), ("n", "u1")])


def refined(here: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifiers of the deeper buckets, from those of each suffix and of its later offset."""
    x = here * _SLOT[2]
    x += later * _SLOT[3]
    x ^= x >> np.uint64(32)
    x *= _SLOT[4]
    x ^= x >> np.uint64(29)
    return x


def buckets_of(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the Q-byte and of the ``length``-byte bucket of every suffix that is long enough."""
    x = _BYTE[data]
    level, depth = refined(refined(x[:-2], x[1:-1]), x[2:]), 3
    while depth < Q:
        level, depth = refined(level[:-depth], level[depth:]), 2 * depth
    grams = level
    while 2 * depth <= length:
        level, depth = refined(level[:-depth], level[depth:]), 2 * depth
    if depth < length:
        level = refined(level[: depth - length], level[length - depth :])
    return grams, level


class Stretch:
    """Anchors of some texts: per anchor its text, place, first string and number of strings."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        n, w = len(data), length - Q + 1
        self.length = length
        if n < length:
            self.p = self.lo = self.hi = self.text = np.zeros(0, np.int64)
            return
        grams, self.strings = buckets_of(data, length)
        least = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span < w:  # least of w neighbours, by doubling
            step = min(span, w - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        size = np.diff(offsets)
        text = np.repeat(np.arange(len(size)), size)[: len(anchor)]
        inside = np.arange(len(anchor)) + length <= offsets[1:][text]
        start = np.flatnonzero(inside)
        anchor, text = anchor[start], text[start]
        head = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) if len(start) else np.zeros(0, bool)
        head = np.flatnonzero(head)
        self.p, self.text, self.lo = anchor[head], text[head], start[head]
        self.hi = start[np.append(head[1:], len(start)) - 1] if len(head) else start
        self.grams, self.gram = grams, grams[self.p]
        self.begin, self.end = offsets[self.text], offsets[self.text + 1]

    def bucket_at(self, at: np.ndarray) -> np.ndarray:
        """16 bits of the identifier of the bucket at other offsets, never 0; 0 where it would leave the text."""
        fits = (at >= self.begin) & (at + Q <= self.end)
        return np.where(fits, np.maximum(self.grams[np.where(fits, at, 0)] & np.uint64(0xFFFF), np.uint64(1)), np.uint64(0))

    def whole(self) -> np.ndarray:
        """Identifiers of the stretches: their first and last strings cover them, being less than one string apart."""
        return mix(refined(self.strings[self.lo], self.strings[self.hi]) + (self.hi - self.lo).astype(np.uint64))


def _pieces(column: pa.Array, length: int):
    """``(data, offsets, row of each piece, first byte of each piece)``, about BLOCK bytes at a time.

    A long text is cut into pieces that overlap by ``length - 1`` bytes: each string is in one piece.
    """
    data, offsets = utf8(column)
    rows, starts, ends, size = [], [], [], 0

    def flush():
        parts = [data[a:b] for a, b in zip(starts, ends)]
        cuts = np.append(0, np.cumsum([b - a for a, b in zip(starts, ends)]))
        return np.concatenate(parts), cuts, np.array(rows), np.array([a - offsets[r] for a, r in zip(starts, rows)])

    for row in range(len(offsets) - 1):
        a, end = int(offsets[row]), int(offsets[row + 1])
        while end - a >= length:
            b = min(end, a + BLOCK + length - 1)
            rows.append(row), starts.append(a), ends.append(b)
            size += b - a
            if size >= BLOCK:
                yield flush()
                rows, starts, ends, size = [], [], [], 0
            a += BLOCK
    if rows:
        yield flush()


def _anchors(buckets: int, length: int):
    half = (length - Q) // 2

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            grams, entries = [], []
            for data, cuts, rows, first in _pieces(batch.column(2), length):
                s = Stretch(data, cuts, length)
                if not len(s.p):
                    continue
                e = np.zeros(len(s.p), _ENTRY)
                e["r"], e["l"] = s.bucket_at(s.p + half), s.bucket_at(s.p - half)
                e["h"], e["doc"], e["at"] = s.gram & np.uint64(0xFFFFFFFF), rows[s.text], s.p - cuts[s.text] + first[s.text]
                e["back"], e["n"] = s.p - s.lo, s.hi - s.lo + 1
                e["c"] = mix(s.whole() + e["back"].astype(np.uint64) * _SLOT[0])
                grams.append(s.gram)
                entries.append(e)
            if not entries:
                continue
            e, gram = np.concatenate(entries), np.concatenate(grams)
            rank = np.unique(ids, return_inverse=True)[1][e["doc"]]
            low, _ = _lowest((e["c"], e["h"]), rank)
            gone = rank > low
            done = _spans(ids, keys, e["doc"][gone], *_ends(e[gone], length))
            e, gram = e[~gone], gram[~gone]
            bucket = ((gram >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, e = bucket[order], e[order]
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            out = []
            for a, b in zip(starts, np.append(starts[1:], len(e))):
                used, local = np.unique(e["doc"][a:b], return_inverse=True)
                part = e[a:b].copy()
                part["doc"] = local
                planes = b"".join(np.ascontiguousarray(part[f]).tobytes() for f in _ENTRY.names)
                out.append((int(bucket[a]), ids[used].astype("<i8").tobytes(), keys[used].astype("<i8").tobytes(), planes, None))
            out += [(i % buckets, np.array([i], "<i8").tobytes(), np.array([k], "<i8").tobytes(), None, spans) for i, k, spans in done]
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["bucket", "ids", "keys", "planes", "spans"])

    return run


def _unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a bucket, and id and key by ``doc``."""
    parts, base = [], 0
    for ids, planes in zip(pdf.ids, pdf.planes):
        n = len(planes) // _ENTRY.itemsize
        e, at = np.empty(n, _ENTRY), 0
        for f in _ENTRY.names:
            kind = _ENTRY[f]
            e[f] = np.frombuffer(planes, kind, n, at)
            at += n * kind.itemsize
        e["doc"] += base
        base += len(ids) // 8
        parts.append(e)
    return np.concatenate(parts), np.frombuffer(b"".join(pdf.ids), "<i8"), np.frombuffer(b"".join(pdf["keys"]), "<i8")


def _shared(key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether another document has the same key."""
    order = np.argsort(key, kind="stable")
    k, d = key[order], rank[order]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    low, high = np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(low < high, np.diff(np.append(starts, len(k))))
    return out


def _lowest(keys: tuple, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least rank among rows with equal keys, and the number of the group of each row."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    starts = np.flatnonzero(new)
    low, group = np.empty(len(order), rank.dtype), np.empty(len(order), np.int64)
    low[order] = np.repeat(np.minimum.reduceat(rank[order], starts), np.diff(np.append(starts, len(order))))
    group[order] = np.cumsum(new) - 1
    return low, group


def _slot(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64) * _SLOT[1] + at.astype(np.uint64)) >> np.uint64(64 - BITS)


def _spans(ids, keys, doc, a, b) -> list[tuple]:
    """One row per document: its stretches, merged, as pairs of uint32."""
    out = []
    if not len(doc):
        return out
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order].astype(np.int64), b[order].astype(np.int64)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    for lo, hi in zip(starts, np.append(starts[1:], len(doc))):
        x, y = merged(a[lo:hi], b[lo:hi])
        out.append((int(ids[doc[lo]]), int(keys[doc[lo]]), np.stack([x, y], 1).astype("<u4").tobytes()))
    return out


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals sorted by start; touching ones are one run."""
    reach = np.maximum.accumulate(b)
    new = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
    return a[new], reach[np.append(new[1:], len(a)) - 1]


def _ends(e: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each entry's stretch, and the one after its last."""
    a = e["at"].astype(np.int64) - e["back"]
    return a, a + e["n"] - 1 + length


def _refine(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done = pdf[pdf.spans.notna()]
        done = [(int.from_bytes(i, "little", signed=True), int.from_bytes(k, "little", signed=True), spans, None) for i, k, spans in zip(done.ids, done["keys"], done.spans)]
        pdf = pdf[pdf.planes.notna()]
        if not len(pdf):
            return pd.DataFrame(done, columns=["id", "key", "spans", "places"])
        e, ids, keys = _unpack(pdf)
        rank = np.unique(ids, return_inverse=True)[1][e["doc"]]  # documents of one id are one
        h = e["h"].astype(np.uint64)
        keep = _shared(h, rank)
        e, rank, h = e[keep], rank[keep], h[keep]
        out, places = [], np.zeros(0, _PLACE)
        if len(e):
            right = _shared((h << np.uint64(16)) | e["r"], rank) & (e["r"] > 0)
            left = _shared((h << np.uint64(16)) | e["l"], rank) & (e["l"] > 0)
            e, rank = e[right | left], rank[right | left]
        if len(e):
            low, _ = _lowest((e["c"], e["h"]), rank)
            gone = rank > low
            out = _spans(ids, keys, e["doc"][gone], *_ends(e[gone], length))
            least_c, _ = _lowest((e["h"],), e["c"])
            most_c, _ = _lowest((e["h"],), ~e["c"])
            open_ = ~gone & (least_c != ~most_c)
            places = np.zeros(int(open_.sum()), _PLACE)
            places["id"], places["key"], places["at"] = ids[e["doc"][open_]], keys[e["doc"][open_]], e["at"][open_]
        rows = done + [(i, k, s, None) for i, k, s in out]
        rows += [(0, 0, None, places.tobytes())] * (len(places) > 0)  # a null among ids would make doubles of them
        return pd.DataFrame(rows, columns=["id", "key", "spans", "places"])

    return run


def _slots(pdfs):
    """Slots of packed places, by part of the bitmap."""
    for pdf in pdfs:
        for blob in pdf.places:
            p = np.frombuffer(blob, _PLACE)
            slots = np.unique(_slot(p["id"], p["at"]))
            part = (slots >> np.uint64(BITS - 7)).astype(np.int64)
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            yield pd.DataFrame({"key": part[cut], "slots": [slots[i:j].astype("<u4").tobytes() for i, j in zip(cut, np.append(cut[1:], len(slots)))]})


def _by_text(pdfs):
    """Packed places, by text."""
    for pdf in pdfs:
        p = np.frombuffer(b"".join(pdf.places), _PLACE)
        p = p[np.lexsort((p["key"], p["id"]))]
        cut = np.flatnonzero(np.append(True, (p["id"][1:] != p["id"][:-1]) | (p["key"][1:] != p["key"][:-1]))) if len(p) else np.zeros(0, np.int64)
        yield pd.DataFrame({"id": p["id"][cut], "key": p["key"][cut], "places": [p["at"][i:j].tobytes() for i, j in zip(cut, np.append(cut[1:], len(p)))]})


def _bitmap(pdf: pd.DataFrame) -> pd.DataFrame:
    size = 1 << (BITS - 7)
    bits = np.zeros(size, np.uint8)
    for s in pdf.slots:
        bits[np.frombuffer(s, "<u4") & (size - 1)] = 1
    return pd.DataFrame({"key": pdf.key.iloc[:1], "bits": [np.packbits(bits).tobytes()]})


def _asked(column: pa.Array) -> np.ndarray:
    """Row and place of all that is wanted of a batch's texts, in one number."""
    held = [np.frombuffer(b"".join(x or ()), "<u4").astype(np.int64) | (row << 32) for row, x in enumerate(column.to_pylist())]
    return np.concatenate(held) if held else np.zeros(0, np.int64)


def _fetch(wanted, buckets: int, length: int):
    """Stretches whose (document, place) is in the bitmap, or without one among the places beside each text, packed by bucket: lengths, then bytes."""

    def run(batches):
        bitmap = np.frombuffer(wanted.value, np.uint8) if wanted else None
        for batch in batches:
            asked = None if wanted else _asked(batch.column(3))
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            out = []
            for data, cuts, rows, first in _pieces(batch.column(2), length):
                s = Stretch(data, cuts, length)
                if not len(s.p):
                    continue
                at = s.p - cuts[s.text] + first[s.text]
                if wanted:
                    slot = _slot(ids[rows[s.text]], at)
                    hit = np.flatnonzero((bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7)).astype(np.uint8))) & 1)
                else:
                    hit = np.flatnonzero(np.isin((rows[s.text].astype(np.int64) << 32) | at, asked))
                bucket = ((s.gram[hit] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                hit = hit[np.argsort(bucket, kind="stable")]
                bucket = np.sort(bucket)
                starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
                for i, j in zip(starts, np.append(starts[1:], len(bucket)) if len(bucket) else []):
                    k = hit[i:j]
                    size = s.hi[k] - s.lo[k] + length
                    index = np.repeat(s.lo[k] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                    doc = rows[s.text[k]]
                    out.append((int(bucket[i]), ids[doc].astype("<i8").tobytes(), keys[doc].astype("<i8").tobytes(), (at[k] - (s.p[k] - s.lo[k])).astype("<u4").tobytes(), size.astype("<u4").tobytes(), data[index].tobytes()))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == 0 else pa.binary()) for n, c in enumerate(cols)], ["bucket", "ids", "keys", "at", "size", "bytes"])

    return run


def _strings(length: int):
    """Sort the strings of fetched stretches; those that a smaller document has go."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, keys = np.frombuffer(b"".join(pdf.ids), "<i8"), np.frombuffer(b"".join(pdf["keys"]), "<i8")
        at, size = np.frombuffer(b"".join(pdf["at"]), "<u4").astype(np.int64), np.frombuffer(b"".join(pdf["size"]), "<u4").astype(np.int64)
        data = np.frombuffer(b"".join(pdf.bytes), np.uint8)
        begin = np.append(0, np.cumsum(size)[:-1])
        owner_all, place_all, value_all = [], [], []
        lo = 0
        while lo < len(size):  # some stretches at a time
            hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + BLOCK)))
            part = data[begin[lo] : begin[hi - 1] + size[hi - 1]]
            n = size[lo:hi] - length + 1
            owner = np.repeat(np.arange(lo, hi), n)
            place = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
            where = place + begin[owner] - begin[lo]
            owner_all.append(owner), place_all.append(place)
            value_all.append(buckets_of(part, length)[1][where])
            lo = hi
        owner, place, value = (np.concatenate(x) for x in (owner_all, place_all, value_all))
        rank = np.unique(ids, return_inverse=True)[1]
        low, _ = _lowest((value,), rank[owner])
        gone = rank[owner] > low
        a = at[owner[gone]] + place[gone]
        doc = np.unique(np.stack([ids, keys], 1), axis=0, return_inverse=True)
        rows = _spans(doc[0][:, 0], doc[0][:, 1], doc[1].ravel()[owner[gone]], a, a + length)
        return pd.DataFrame(rows, columns=["id", "key", "spans"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """``(id, key, spans)``: byte stretches to remove, in no order and possibly overlapping.

    ``key`` is the hash of the text, which tells rows of one id apart; they don't remove each other's
    bytes. ``spans`` holds pairs of little-endian uint32. Null ids and null texts have no rows.
    """
    assert length > Q
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).where("id is not null and octet_length(text) >= {}".format(length))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(16, -(-total * 2 // ((length - Q + 2) * BUCKET))))
    packed = rows.mapInArrow(_anchors(buckets, length), "bucket int, ids binary, keys binary, planes binary, spans binary")
    first = scratch.save(packed.groupBy("bucket").applyInPandas(_refine(length), "id long, key long, spans binary, places binary"))

    places = first.where("places is not null").select("places")
    open_ = (places.agg(F.sum(F.octet_length("places"))).first()[0] or 0) // _PLACE.itemsize
    kind = "bucket int, ids binary, keys binary, at binary, size binary, bytes binary"
    if open_ * FILL <= 1 << BITS:
        # 2 ** BITS bits at most, whatever the input: others than those wanted may pass, none is missed
        bitmap = np.zeros(1 << (BITS - 3), np.uint8)
        for r in places.mapInPandas(_slots, "key long, slots binary").groupBy("key").applyInPandas(_bitmap, "key long, bits binary").collect():
            part = np.frombuffer(r.bits, np.uint8)
            bitmap[r.key * len(part) : (r.key + 1) * len(part)] = part
        fetched = rows.mapInArrow(_fetch(spark.sparkContext.broadcast(bitmap.tobytes()), buckets, length), kind)
    else:
        asked = places.mapInPandas(_by_text, "id long, key long, places binary").groupBy("id", "key").agg(F.collect_list("places").alias("places"))
        fetched = rows.join(asked, ["id", "key"]).select("id", "key", "text", "places").mapInArrow(_fetch(None, buckets, length), kind)
    more = fetched.groupBy("bucket").applyInPandas(_strings(length), "id long, key long, spans binary")
    return first.where("spans is not null").select("id", "key", "spans").union(scratch.save(more))


def _cut(batches):
    """Rows (id, text, list of packed spans) with the remaining bytes and figures."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        kept, removed, runs = [], [], []
        for r, spans in enumerate(batch.column(2).to_pylist()):
            text = data[offsets[r] : offsets[r + 1]]
            if spans:
                pairs = np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2).astype(np.int64)
                a, b = merged(*pairs[np.argsort(pairs[:, 0], kind="stable")].T)
                hole = np.zeros(len(text) + 1, np.int64)
                hole[a] += 1
                hole[b] -= 1
                rest = text[np.cumsum(hole)[:-1] == 0]
                runs.append(len(a))
            else:
                rest = text
                runs.append(0)
            kept.append(rest.tobytes())
            removed.append(len(text) - len(rest))
        size = np.diff(offsets)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
            ["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept)`` of each row; ``kept`` is the bytes that remain.

    A null text is empty. A row with a null id keeps all its bytes and removes none. An empty table
    gives an empty result; other columns are ignored.
    """
    spans = repeated_spans(docs, id_col, text_col, length).groupBy("id", "key").agg(F.collect_list("spans").alias("spans"))
    spans = Scratch(docs.sparkSession, "spans").save(spans.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "spans"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    kind = "id long, n_bytes long, n_removed long, n_spans long, kept binary"
    found = rows.join(spans, (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return found.select("id", "text", "spans").mapInArrow(_cut, kind)
