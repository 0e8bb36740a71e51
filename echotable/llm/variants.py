"""Spelling variant grouping by bidirectional FM-index search schemes.

1. Words are counted in every task before anything is shuffled.
2. The vocabulary is cut into shards of about ``SHARD`` words twice: in the order of the words, and in that of the
   reversed words. Two words one error apart share the first or the second half of either of them, so a
   word visits the shards which its half's range touches, mostly one in each order.
3. A shard holds a bidirectional FM-index of its delimited words. All words that visit it are searched together:
   the half is matched exactly from its end leftwards to the delimiter, on intervals kept in step in both
   directions, and then extended rightwards across the other half with one error. Reversed words
   serve for the other half, and skip what the first search has found.
4. Of the near words a shard returns the number and the most frequent one; forms are followed by pointer doubling.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotable.llm.hashing import utf8
from echotable.llm.storage import Scratch

#: Words of a shard, about; sampled words for each of its bounds; words searched at once.
SHARD, SAMPLES, TOGETHER = 1 << 15, 32, 4096
#: Distinct words that a task counts before it hands them on.
FLUSH = 1 << 18
#: One word in so many occurrences gets a planted error.
PLANTED = 97
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LAST = "\U0010ffff"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, fewest: int = 3, planted: int = PLANTED) -> DataFrame:
    """``(word, n)`` of the runs of letters A to Z and U+00C0 to U+00FF, in lower case (A-Z only), of all texts.

    Where ``planted`` divides the crc32 of ``<id>:<run>``, the run loses the code point at that crc32 modulo its length;
    0 plants nothing. Words of fewer than ``shortest`` code points or ``fewest`` occurrences are left out. A
    null text has no words; a null id is an empty one; repeated rows count each.
    """
    letters = re.compile("[A-Za-zÀ-ÿ]{%d,}" % max(1, shortest))

    def batch_of(total: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches):
        total: dict[str, int] = {}
        crc = zlib.crc32
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            data = data.tobytes().translate(_LOWER)
            for key, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                seed = crc(f"{key or ''}:".encode())
                for word, n in Counter(letters.findall(data[a:b].decode("utf-8", "replace"))).items():
                    if planted:
                        h = crc(word.encode(), seed)
                        if not h % planted:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                    total[word] = total.get(word, 0) + n
                if len(total) >= FLUSH:
                    yield batch_of(total)
                    total = {}
        if total:
            yield batch_of(total)

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


class Ranks:
    """An FM-index of a cyclic text: how many symbols below c stand before place p of its Burrows-Wheeler transform."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        bits = symbols.bit_length()
        width = 62 // bits
        key = np.zeros(n, np.int64)
        for j in range(width):
            key = key << bits | np.roll(text, -j)
        rank = np.unique(key, return_inverse=True)[1]
        while int(rank.max()) + 1 < n:
            rank = np.unique(rank * n + np.roll(rank, -width), return_inverse=True)[1]
            width *= 2
        self.place = np.empty(n, np.int64)
        self.place[rank] = np.arange(n)
        last = text[self.place - 1]
        blocks = n // 64 + 1
        held = np.zeros((symbols + 1, blocks * 8), np.uint8)
        for c in range(1, symbols + 1):
            row = np.packbits(last < c, bitorder="little")
            held[c, : len(row)] = row
        self.bits = np.ascontiguousarray(held.view(np.uint64).T)
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = (np.cumsum(ones, 0) - ones).astype(np.int32)
        self.first = np.searchsorted(np.sort(last), np.arange(symbols + 1))

    def below(self, c, p: np.ndarray) -> np.ndarray:
        """Symbols under c before place p; with c a slice, a column for each."""
        block, mask = p >> 6, (np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)
        if isinstance(c, slice):
            block, mask = block, mask[:, None]
            return self.before[block, c] + np.bitwise_count(self.bits[block, c] & mask)
        return self.before[block, c] + np.bitwise_count(self.bits[block, c] & mask)


class Shard:
    """Bidirectional FM-index of distinct words, each between two delimiters of a cyclic text."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer(("\0" + "\0".join(words)).encode("utf-32-le"), np.uint32)
        self.alphabet, text = np.unique(codes, return_inverse=True)
        self.symbols = len(self.alphabet)
        self.left, self.right = Ranks(text, self.symbols), Ranks(text[::-1], self.symbols)
        ends = len(text) - 1 - self.right.place  # of each row of the right index: its first symbol's place in the text
        number = np.cumsum(text == 0) - 1
        self.word_before = np.where(text[ends] == 0, (number[ends] - 1) % len(words), -1)

    def _coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words in rows, -1 where the alphabet has none; and their lengths."""
        size = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, codes), self.symbols - 1)
        row = np.repeat(np.arange(len(words)), size)
        out = np.full((len(words), int(size.max()) + 1), -1, np.int64)
        out[row, np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)] = np.where(self.alphabet[at] == codes, at, -1)
        return out, size

    @staticmethod
    def _extend(index: Ranks, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval after one more symbol, and how far the other direction's interval moves; empty for symbol -1."""
        known = np.maximum(c, 0)
        a, b = index.below(known, lo), index.below(known, hi)
        start = index.first[known]
        up, down = start + index.below(known + 1, lo) - a, start + index.below(known + 1, hi) - b
        return up, np.where(c < 0, up, down), b - a

    def near(self, words: list[str], exact: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers: indexed words one error from each query, equal in the query's first ``exact`` symbols."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        found = []
        for a in range(0, len(order), TOGETHER):
            part = order[a : a + TOGETHER]
            q, w = self._near([words[i] for i in part], np.array([exact[i] for i in part]))
            found.append(np.array(part, np.int64)[q] << 32 | w)
        pair = np.unique(np.concatenate(found))
        return pair >> 32, pair & 0xFFFFFFFF

    def _near(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, size = self._coded(words)
        # the exact part, from its end to the delimiter before it
        q = np.arange(len(words))
        lo, hi, other = np.zeros(len(q), np.int64), np.full(len(q), len(self.left.place)), np.zeros(len(q), np.int64)
        ready = []
        for k in range(int(exact.max()) + 1):
            c = np.where(k < exact[q], code[q, np.maximum(exact[q] - 1 - k, 0)], 0)
            lo, hi, shift = self._extend(self.left, c, lo, hi)
            other = other + shift
            done = (k == exact[q]) & (hi > lo)
            ready.append((q[done], other[done], (other + hi - lo)[done]))
            go = (k < exact[q]) & (hi > lo)
            q, lo, hi, other = q[go], lo[go], hi[go], other[go]
        q, lo, hi = (np.concatenate(x) for x in zip(*ready))
        at = exact[q]
        # the other half: exact so far (q, lo, hi, at), and after the error (e...)
        eq, elo, ehi, eat = (np.zeros(0, np.int64) for _ in range(4))
        hits = []
        while len(q) or len(eq):
            if len(eq):
                end = eat == size[eq]
                c = np.where(end, 0, code[eq, eat])
                elo, ehi, _ = self._extend(self.right, c, elo, ehi)
                live = ehi > elo
                out = end & live
                hits.append((eq[out], self.word_before[elo[out]]))
                go = ~end & live
                eq, elo, ehi, eat = eq[go], elo[go], ehi[go], eat[go] + 1
            if len(q):
                a, b = self.right.below(slice(None), lo), self.right.below(slice(None), hi)
                start = self.right.first[1:-1]
                child_lo, child_hi = start + a[:, 2:] - a[:, 1:-1], start + b[:, 2:] - b[:, 1:-1]
                row, c = np.nonzero(child_hi > child_lo)
                child_lo, child_hi, c = child_lo[row, c], child_hi[row, c], c + 1
                more = at[row] < size[q[row]]
                want = np.where(more, code[q[row], at[row]], -1)
                swap, same, drop = more & (c != want), more & (c == want), at < size[q]
                new = [  # a symbol put in, one replaced, one left out
                    (q[row], child_lo, child_hi, at[row]), (q[row][swap], child_lo[swap], child_hi[swap], at[row][swap] + 1), (q[drop], lo[drop], hi[drop], at[drop] + 1),
                ]
                eq, elo, ehi, eat = (np.concatenate([old, *(x[k] for x in new)]) for k, old in enumerate((eq, elo, ehi, eat)))
                q, lo, hi, at = q[row][same], child_lo[same], child_hi[same], at[row][same] + 1
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*hits))


def _bounds(words: DataFrame, shards: int, total: int) -> list[str]:
    """Upper bounds of all shards but the last, from about ``SAMPLES`` words of each."""
    if shards < 2:
        return []
    every = max(1, total // (shards * SAMPLES))
    sample = sorted(r[0] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).collect())
    return [sample[len(sample) * i // shards] for i in range(1, shards)] if len(sample) >= shards else []


def _dealer(shared):
    def run(pdfs):
        for pdf in pdfs:
            out = []
            for word, n in zip(pdf.word, pdf.n):
                half = len(word) // 2
                for side, (w, head) in enumerate(((word, word[:half]), (word[::-1], word[half:][::-1]))):
                    bounds = shared.value[side]
                    own = bisect_right(bounds, w)
                    for shard in range(bisect_right(bounds, head), bisect_right(bounds, head + _LAST) + 1):
                        out.append((side, shard, word, n, shard == own))
            yield pd.DataFrame(out, columns=["side", "shard", "word", "n", "own"])

    return run


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """Near words of all words that visit one shard: their number and the most frequent one."""
    side, own = int(pdf.side.iloc[0]), pdf[pdf.own]
    names, n = own.word.tolist(), own.n.to_numpy()
    out = {"word": [], "n_near": [], "form_n": [], "form": []}
    if names:
        turned = (lambda w: w[::-1]) if side else (lambda w: w)
        asked = pdf.word.tolist()
        q, w = Shard([turned(x) for x in names]).near([turned(x) for x in asked], [len(x) - len(x) // 2 if side else len(x) // 2 for x in asked])
        if side:  # the other side finds those that share the first half as well
            new = np.array([not names[j].startswith(asked[i][: len(asked[i]) // 2]) for i, j in zip(q.tolist(), w.tolist())], bool)
            q, w = q[new], w[new]
        place = np.empty(len(names), np.int64)
        place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        order = np.lexsort((place[w], -n[w], q))
        q, w = q[order], w[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else q
        out = {"word": [asked[i] for i in q[first].tolist()], "n_near": np.diff(np.append(first, len(q))), "form_n": n[w[first]], "form": [names[j] for j in w[first].tolist()]}
    return pd.DataFrame(out).astype({"n_near": "int64", "form_n": "int64"})


def near_words(vocabulary: DataFrame, scratch: Scratch, shard_words: int = SHARD) -> DataFrame:
    """``(word, n_near, form_n, form)`` of each of the distinct words ``(word, n)`` that has one by one error: their number, and the one of largest n (ties: the smallest)."""
    total = vocabulary.count()
    shards = max(1, math.ceil(total / shard_words))
    bounds = [_bounds(vocabulary.select(w.alias("word")), shards, total) for w in (F.col("word"), F.reverse("word"))]
    shared = vocabulary.sparkSession.sparkContext.broadcast(bounds)
    dealt = vocabulary.mapInPandas(_dealer(shared), "side int, shard int, word string, n long, own boolean")
    found = dealt.groupBy("side", "shard").applyInPandas(_search, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("x"), "form")).alias("b")
    return scratch.save(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.x")).alias("form_n"), F.col("b.form").alias("form")))


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(word, root)`` of acyclic links ``(word, form)``: where following them ends; pointers double in each round."""
    now = scratch.save(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = scratch.save(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        scratch.drop(now)
        now = after.select("word", "root")
        now._scratch_path = after._scratch_path
        if after.where("moved").isEmpty():
            return now


def variant_groups(vocabulary: DataFrame, scratch: Scratch | None = None, times: int = 2, shard_words: int = SHARD) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of each of the distinct words ``(word, n)``.

    A word's form is its near word of largest n, the smallest of equals, if that n is at least ``times`` (over 1) its own;
    ``root`` is where forms end, the word itself without one. No words: no rows.
    """
    scratch = scratch or Scratch(vocabulary.sparkSession, "variants")
    vocabulary = scratch.save(vocabulary.select("word", "n"))
    known = scratch.save(vocabulary.join(near_words(vocabulary, scratch, shard_words), "word", "left"))
    takes = F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False))
    rows = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n"))
    ends = roots(rows.where("form is not null"), scratch)
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
