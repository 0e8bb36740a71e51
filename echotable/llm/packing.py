"""Lexical retrieval packing.

1. Documents are tokenised once; each row keeps its ids, an end id appended, and each task sends
   one document-frequency array over the vocabulary (its size is the vocabulary's).
2. Whole windows of a long document are sequences of their own. What is left of a document, less
   than a window, is dealt by range of its two rarest ids (the vocabulary lists rarer tokens
   later), so that documents that share rare tokens meet in one index shard.
3. Each shard builds a BM25 inverted index over its documents, with document frequencies of the
   whole table. The first unused document seeds a sequence; its best-scored unused neighbours fill
   the window, the last cut to fit, and what is cut off stays unused. Only a shard's last sequence
   can be short.

Nothing is dropped: each id of each document is in exactly one piece.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotable.llm.bpe import encoder
from echotable.llm.storage import Scratch
from echotable.llm.tables import add_arrays

#: Vocabulary size with the end id, and the documents of one index shard.
VOCAB, SHARD = 50_258, 2048
K1, B = 1.2, 0.75
_PARTS = 16
_PIECE = "id {id_type}, start long, ids binary, doc_tokens long, sequence_id long, offset long"
_NAMES = ["id", "start", "ids", "doc_tokens", "sequence_id", "offset"]


def _tokenise(name: str, end_id: int, window: int):
    cut = -(-VOCAB // _PARTS)

    def run(batches):
        enc, task = encoder(name), TaskContext.get().partitionId()
        seen = np.zeros(cut * _PARTS, np.int64)
        names = ["id", "ids", "n", "rare", "rare2", "part", "task", "counts"]
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 512):
                part = texts.slice(lo, 512).to_pylist()
                rows = []
                for ids in enc.batch(part):
                    ids = np.append(ids, end_id).astype(np.uint16)
                    terms = np.sort(ids[len(ids) // window * window :])
                    terms = terms[np.append(terms[:-1] != terms[1:], True)[: len(terms)]]
                    seen[terms] += 1
                    rare = terms[terms != end_id][-2:]
                    rows.append((ids.tobytes(), len(ids), int(rare[-1]) if len(rare) else -1, int(rare[0]) if len(rare) > 1 else -1))
                a, b, c, d = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, 512), pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.int32()),
                     pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())], names)
        if kind is not None:
            blobs = [seen[i * cut : (i + 1) * cut].tobytes() for i in range(_PARTS)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(_PARTS, kind), pa.nulls(_PARTS, pa.binary()), *(pa.nulls(_PARTS, t) for t in (pa.int64(), pa.int32(), pa.int32())),
                 pa.array(range(_PARTS), pa.int32()), pa.array([task] * _PARTS, pa.int64()), pa.array(blobs, pa.binary())], names)

    return run


def _whole_windows(window: int):
    """Pieces of documents that fill a window by themselves."""

    def run(batches):
        base, local = (2 * TaskContext.get().partitionId() + 1) << 31, 0
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            owner = []
            for r, (blob, n) in enumerate(zip(batch.column(1), batch.column(2).to_pylist())):
                ids = memoryview(blob.as_buffer())
                for k in range(n // window):
                    owner.append(r)
                    for col, v in zip(rows, (k * window, bytes(ids[2 * k * window : 2 * (k + 1) * window]), n, base | local, 0)):
                        col.append(v)
                    local += 1
            yield _pieces(batch.column(0).take(pa.array(owner, pa.int64())), *rows)

    return run


def _pieces(ids, start, blob, n, sequence, offset) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(start, pa.int64()), pa.array(blob, pa.binary()), pa.array(n, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], _NAMES
    )


class Shard:
    """BM25 inverted index over token arrays; ``df`` and ``total`` are of the whole table."""

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, total: int):
        size = np.array([len(d) for d in docs])
        flat = np.concatenate(docs).astype(np.int64) * len(docs) + np.repeat(np.arange(len(docs)), size)
        cell, tf = np.unique(flat, return_counts=True)
        term, doc = np.divmod(cell, len(docs))
        idf = np.log((total - df + 0.5) / (df + 0.5))[term]  # below 0 for terms in over half of all documents: they say nothing
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / size.mean()))
        useful = idf > 0
        self.doc, self.weight, term = doc[useful], weight[useful].astype(np.float64), term[useful]
        heads = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        self.at = {int(t): slice(a, b) for t, a, b in zip(term[heads], heads, np.append(heads[1:], len(term)))}
        self.n, self.docs = len(docs), docs

    def score(self, seed: int) -> np.ndarray:
        """BM25 of every document against the distinct terms of ``seed``."""
        cuts = [self.at[t] for t in np.unique(self.docs[seed]).tolist() if t in self.at]
        if not cuts:
            return np.zeros(self.n)
        doc = np.concatenate([self.doc[c] for c in cuts])
        return np.bincount(doc, np.concatenate([self.weight[c] for c in cuts]), self.n)


def fill(index: Shard, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(document, start, length)`` that use every token once."""
    size = np.array([len(d) for d in index.docs])
    start, left = np.zeros_like(size), size.copy()
    out = []
    for seed in range(len(size)):
        while left[seed]:
            room = window - left[seed]
            sequence = [(seed, int(start[seed]), int(left[seed]))]
            start[seed], left[seed] = size[seed], 0
            if room:
                score = np.where(left > 0, index.score(seed), -1.0)
                for near in _best(score):
                    take = int(min(room, left[near]))
                    sequence.append((near, int(start[near]), take))
                    start[near] += take
                    left[near] -= take
                    room -= take
                    if not room:
                        break
            out.append(sequence)
    return out


def _best(score: np.ndarray):
    """Unused documents by falling score, ties by place; a few first, all if they don't do."""
    few = min(16, len(score))
    top = np.argpartition(-score, few - 1)[:few]
    done = set()
    for i in top[np.lexsort((top, -score[top]))].tolist():
        if score[i] >= 0:
            done.add(i)
            yield i
    for i in np.argsort(-score, kind="stable").tolist():
        if score[i] < 0:
            return
        if i not in done:
            yield i


def _pack_shard(shared, total: int, window: int):
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        rows = rows.sort_by([("rare", "ascending"), ("rare2", "ascending"), ("id", "ascending"), ("ids", "ascending")])
        n = rows["n"].to_pylist()
        skip = [k // window * window for k in n]
        docs = [np.frombuffer(v, np.uint16) for v in rows["ids"].to_pylist()]
        base = (2 * TaskContext.get().partitionId()) << 31
        owner, cols = [], [[] for _ in range(5)]
        for s, sequence in enumerate(fill(Shard(docs, np.frombuffer(shared.value, np.int64), total), window)):
            offset = 0
            for d, start, length in sequence:
                owner.append(d)
                for col, v in zip(cols, (skip[d] + start, docs[d][start : start + length].tobytes(), n[d], base | s, offset)):
                    col.append(v)
                offset += length
        yield _pieces(rows["id"].combine_chunks().take(pa.array(owner, pa.int64())), *cols)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, tokenizer: str = "byte_bpe_50k.json", shard_docs: int = SHARD) -> DataFrame:
    """Pieces ``(id, start, ids, doc_tokens, sequence_id, offset)``; ``ids`` is little-endian uint16.

    ``start`` counts the document's ids before the piece, ``offset`` those of its sequence. A null or
    empty text is the end id alone. Rows are packed as they are: a repeated or null id gives its own
    pieces. An empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = scratch.save(rows.mapInArrow(_tokenise(tokenizer, end_id, window), f"id {kind}, ids binary, n long, rare int, rare2 int, part int, task long, counts binary"))
    parts = add_arrays(made.where("part is not null").select("part", "task", "counts"), "int64")
    df = np.concatenate([parts[i] for i in range(_PARTS)]) if parts else np.zeros(VOCAB, np.int64)
    ids = made.where("part is null")
    rest = ids.where(f"n % {window} > 0")
    total = rest.count()
    shared = spark.sparkContext.broadcast(df.tobytes())
    schema = _PIECE.format(id_type=kind)
    rest = rest.select("id", F.expr(f"substring(ids, cast(2 * {window} * (n div {window}) + 1 as int), {2 * window})").alias("ids"), "n", "rare", "rare2")
    rest = rest.repartitionByRange(max(1, math.ceil(total / shard_docs)), "rare", "rare2", "id")
    packed = rest.mapInArrow(_pack_shard(shared, total, window), schema)
    whole = ids.where(f"n >= {window}").select("id", "ids", "n").mapInArrow(_whole_windows(window), schema)
    return packed.unionAll(whole)


def digest(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``length`` and ``ids_crc32`` (of unsigned 32-bit ids) in place of the ids."""

    def run(batches):
        for batch in batches:
            blobs = batch.column(2)
            crc = [zlib.crc32(np.frombuffer(b.as_buffer(), np.uint16).astype("<u4").tobytes()) for b in blobs]
            size = [len(b.as_buffer()) // 2 for b in blobs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), *(batch.column(i) for i in (3, 4, 5))],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = pieces.schema["id"].dataType.simpleString()
    return pieces.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
