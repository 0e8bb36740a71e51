"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-gram buckets for each language over a bounded sample of labelled rows; each task
sends one array of counts per language. The log-probability matrix, ``languages x 2 ** bits``
doubles with at most ``max_languages`` languages, is broadcast. Scoring gathers matrix entries for
every n-gram of the whole text in numpy and sums them by document; no shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotable.llm.hashing import mix
from echotable.llm.storage import Scratch, bounded_batches
from echotable.llm.tables import add_arrays, map_in_arrow

_LETTER = regex.compile(r"\p{L}")
_SLOT = np.random.default_rng(7).integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Characters handled at once.
BLOCK = 1 << 18


def ngram_blocks(texts: list[str], orders: tuple[int, ...], bits: int):
    """Yield ``(bucket, text index)`` arrays: every hashed n-gram of every text, in blocks.

    A long text runs over several blocks, which overlap so that no n-gram is lost or counted twice.
    """
    group: list[tuple[int, str]] = []
    size, tail, lap = 0, 0, max(orders) - 1

    def flush():
        joined = "".join(t for _, t in group)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        owner = np.repeat(np.arange(len(group)), [len(t) for _, t in group])
        index = np.array([i for i, _ in group])
        for n in orders:
            if len(code) < n:
                continue
            h = code[: len(code) - n + 1] * _SLOT[0] + np.uint64(n)
            for k in range(1, n):
                h += code[k : len(code) - n + 1 + k] * _SLOT[k]
            inside = owner[: len(h)] == owner[n - 1 :]
            inside[: max(0, tail - n + 1)] = False  # they end within the overlap: counted before
            at = (mix(h[inside]) >> np.uint64(64 - bits)).astype(np.int64)
            yield at, index[owner[: len(h)][inside]]

    for i, text in enumerate(texts):
        for at in range(0, len(text), BLOCK):
            piece = text[max(0, at - lap) : at + BLOCK]
            if at:
                yield from flush()
                group, size, tail = [], 0, min(at, lap)
            group.append((i, piece))
            size += len(piece)
        if size >= BLOCK:
            yield from flush()
            group, size, tail = [], 0, 0
    if group:
        yield from flush()


def _clean(texts) -> list[str]:
    return [(t or "").lower() for t in texts]


def _count(orders, bits):
    def run(pdfs):
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for pdf in pdfs:
            texts, langs = _clean(pdf.text), pdf.lang.tolist()
            names = np.array([langs[i] for i in range(len(texts))], object)
            for name in set(langs):
                docs[name] = docs.get(name, 0) + langs.count(name)
                total.setdefault(name, np.zeros(1 << bits, np.int64))
            for at, index in ngram_blocks(texts, orders, bits):
                owner = names[index]
                for name in set(names[np.unique(index)]):
                    total[name] += np.bincount(at[owner == name], minlength=1 << bits)
        if total:
            task = TaskContext.get().partitionId()
            yield pd.DataFrame({"lang": list(total), "task": task, "docs": [docs[k] for k in total], "counts": [v.tobytes() for v in total.values()]})

    return run


class LanguageModel:
    """Sorted language names, their log priors, and log probabilities by language and bucket."""

    def __init__(self, names: list[str], prior: np.ndarray, logp: np.ndarray, orders: tuple[int, ...], bits: int):
        self.names, self.prior, self.logp, self.orders, self.bits = names, prior, logp, orders, bits

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """Predicted language and its posterior probability; ``und`` and 0 without a letter."""
        lower = _clean(texts)
        spoken = np.array([bool(_LETTER.search(t)) for t in lower], bool)
        if not self.names or not spoken.any():
            return ["und"] * len(texts), np.zeros(len(texts))
        score = np.tile(self.prior, (len(texts), 1))
        for at, index in ngram_blocks(lower, self.orders, self.bits):
            starts = np.flatnonzero(np.append(True, index[1:] != index[:-1])) if len(index) else []
            if len(starts):
                for k in range(len(self.names)):
                    np.add.at(score[:, k], index[starts], np.add.reduceat(self.logp[k][at], starts))
        best = score.argmax(1)  # names are sorted: the first of equals
        odds = np.exp(score - score.max(1, keepdims=True))
        sure = 1 / odds.sum(1)
        return [self.names[b] if s else "und" for b, s in zip(best, spoken)], np.where(spoken, sure, 0.0)


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    key: str | Column = "doc_id",
    sample_rows: int = 20_000,
    orders: tuple[int, ...] = (1, 2, 3),
    bits: int = 16,
    alpha: float = 0.5,
    max_languages: int = 256,
) -> LanguageModel:
    """Fit on about ``sample_rows`` labelled rows, chosen by a hash of ``key``.

    Rows with a null text or label are not used. No rows: a model that answers ``und``.
    More than ``max_languages`` labels raise an error: that bounds what is broadcast.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(key).alias("k"))
    rows = rows.where("text is not null and lang is not null")
    n = labelled.where(F.col(lang_col).isNotNull()).count()
    if n > sample_rows:
        rows = rows.where(F.pmod("k", F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    scratch = Scratch(labelled.sparkSession, "langid")
    counted = scratch.save(rows.select("text", "lang").mapInPandas(_count(orders, bits), "lang string, task long, docs long, counts binary"))
    got = counted.groupBy("lang").agg(F.sum("docs").alias("docs")).limit(max_languages + 1).collect()
    if len(got) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    got = sorted(got, key=lambda r: r.lang)
    names = [r.lang for r in got]
    if not names:
        return LanguageModel([], np.zeros(0), np.zeros((0, 0)), orders, bits)
    part = (F.array_position(F.array(*map(F.lit, names)), F.col("lang")) - 1).cast("int").alias("part")
    sums = add_arrays(counted.select(part, "task", "counts"), "int64")
    scratch.drop(counted)
    counts = np.array([sums[k] for k in range(len(names))]) + alpha
    logp = np.log(counts) - np.log(counts.sum(1, keepdims=True))
    docs = np.array([r.docs for r in got], float)
    return LanguageModel(names, np.log(docs / docs.sum()), logp, orders, bits)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (columns of those names are replaced).

    A null text, or one without a letter, gives ``und`` with score 0. Each row is judged by itself, so
    repeated rows get equal answers; an empty table gives none.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text_col)
    frame = docs.select(*[F.col(f"`{c}`") for c in keep])

    def run(batch):
        names, sure = shared.value.predict(batch.column(at).to_pylist())
        yield [*batch.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64())]

    return map_in_arrow(frame, run, [("lang_pred", "string"), ("score", "double")])
