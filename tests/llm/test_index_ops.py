"""Decontamination, whitening and spelling variants against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from echotable.llm import decontam, variants, whiten
from echotable.llm.storage import Scratch

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_hits(docs, items, n, slop):
    tests = {}
    for name, text in items:
        w = WORD.findall(lower(text))
        if name is not None and w:
            k = min(n, len(w))
            tests.setdefault(str(name), set()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for d, text in docs:
        w = WORD.findall(lower(text))
        hit, exact, near = set(), set(), set()
        for name, windows in tests.items():
            for win in windows:
                for s in range(-slop, len(w)):
                    if 0 <= s and tuple(w[s : s + len(win)]) == win:
                        hit.update(range(s, s + len(win)))
                        exact.add(name)
                    if name not in near and all(x in w[max(0, s + j - slop) : max(0, s + j + slop + 1)] for j, x in enumerate(win)):
                        near.add(name)
        out.append((d, len(w), len(hit), hashlib.sha256(",".join(sorted(exact)).encode()).hexdigest(), len(exact), len(near)))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def tested():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdé1") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    items = [(i, text(rng.randint(10, 25))) for i in range(12)] + [(20, "One, two!"), (21, ""), (22, None), (None, text(12)), (23, " -- "), (5, text(14)), (24, items_text := text(11)), (24, items_text)]
    docs = []
    for i in range(60):
        w = text(rng.randint(0, 60)).split()
        if i % 3 == 0:
            source = items[rng.randrange(12)][1].split()
            a = rng.randrange(len(source) - 8)
            at = rng.randint(0, len(w))
            w = w[:at] + source[a : a + rng.randint(8, 20)] + w[at:]
        if i % 5 == 0 and len(w) > 12:  # two neighbours exchanged
            w[6], w[7] = w[7], w[6]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper() if i % 4 == 0 else " ".join(w)))
    docs += [(60, None), (61, ""), (62, "  .,"), (63, "ONE;two"), (64, items[0][1] + " " + items[1][1]), (3, docs[3][1]), (None, items[2][1]), (65, "x" * 5000 + " " + items[3][1] + " y" * 3000)]
    return docs, items


@pytest.mark.parametrize("segment,block,slop", [(decontam.SEGMENT, decontam.BLOCK, 2), (40, 150, 1), (200, 40, 0)])
def test_decontamination_equals_brute_force(spark, tested, segment, block, slop, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT", segment)
    monkeypatch.setattr(decontam, "STEP", 50)
    docs, items = tested
    d = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, `a.b` string, segment int").repartition(3)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, name int").repartition(2)
    found = decontam.search(decontam.build_index(d), b, slop=slop, block_chars=block)
    got = []
    for r in found.collect():
        n = sum(s.end - s.start for s in r.spans)
        assert all(x.end < y.start for x, y in zip(r.spans, r.spans[1:]))
        got.append((r.id, r.n_words, n, hashlib.sha256(",".join(sorted(set(r["items"]))).encode()).hexdigest(), len(set(r["items"])), len(set(r.near_items))))
    assert sorted(map(repr, got)) == brute_hits(docs, items, 10, slop)


def test_decontamination_of_empty_tables(spark, tested):
    docs, items = tested
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.decontaminate(d.limit(0), b).count() == 0
    none = decontam.decontaminate(d, b.limit(0))
    assert none.count() == len(docs) and none.where("contaminated or n_items > 0 or n_near > 0").count() == 0
    with pytest.raises(ValueError):
        decontam.search(decontam.build_index(d), b, slop=8)


def brute_whitening(rows, most=32):
    x = np.array([np.floor(64 * np.array(v, np.float64)) + 1_000_000 for _, v in rows])
    n, s = len(x), x.sum(0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    y = x - x.mean(0)
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return deviation, y @ v / np.sqrt(e), e / np.trace(y.T @ y / n)


def test_whitening_equals_dense_algebra(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(40, 40)) * 3
    rows = [(i, [float(a) for a in rng.normal(size=40) @ mix]) for i in range(300)]
    rows += [(7, rows[8][1]), (None, rows[9][1]), (300, [0.0] * 40)]
    odd = [(400, None), (401, [None] + [1.0] * 39), (402, [float("nan")] * 40), (403, [float("-inf")] + [0.0] * 39), (404, []), (405, [1.0] * 39), (406, [1e300] + [0.0] * 39)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, `index` int").repartition(4)
    got = whiten.whitened_rows(df).collect()
    deviation, z, explained = brute_whitening(rows)
    assert len(got) == len(rows) and {r.n for r in got} == {len(rows)}
    key = lambda i, d: (i is not None, i or 0, d)
    got.sort(key=lambda r: key(r.id, r.deviation))
    order = sorted(range(len(rows)), key=lambda k: key(rows[k][0], deviation[k]))
    assert [r.deviation for r in got] == [deviation[k] for k in order]
    mine = np.array([r.whitened for r in got])
    want = z[order]
    sign = np.sign((mine * want).sum(0))
    assert np.abs(mine * sign - want).max() < 1e-6
    assert np.allclose(got[0].explained, explained, rtol=1e-9) and all(r.identity_error < 1e-8 for r in got)
    long = whiten.whitened_components(df)
    assert long.count() == 32 * len(rows) and long.where("component between 1 and 32").count() == 32 * len(rows)


def test_whitening_of_degenerate_tables(spark):
    make = lambda vs: spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "vec_id long, embedding array<float>")
    assert whiten.whitened_rows(make([None, []])).count() == 0
    assert whiten.whitened_components(make([None])).columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whiten.whitened_rows(make([[1.0, 2.0]])).first()
    assert one.deviation == 0 and one.whitened == [None, None] and one.explained == [None, None] and one.identity_error is None
    line = whiten.whitened_rows(make([[float(i), 2.0 * i, 5.0] for i in range(50)])).collect()
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in line) and abs(line[0].explained[0] - 1) < 1e-9
    assert line[0].identity_error < 1e-9


def brute_words(docs, shortest=5, fewest=3):
    n = {}
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] = n.get(w, 0) + 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= fewest}


def one_error(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute_groups(n):
    near = {w: sorted((x for x in n if one_error(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= 2 * n[w] else None for w in n}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


@pytest.mark.parametrize("shard", [variants.SHARD, 25])
def test_spelling_variants_equal_brute_force(spark, shard):
    rng = random.Random(5)
    letters = "aabbcdeéÿÀ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "ababab", "abababa", "x" * 300, "x" * 299 + "y"]
    counts = {}
    for w in base:
        counts[w] = rng.choice([3, 5, 9, 20, 20])
        for _ in range(rng.randint(0, 6)):
            p, c = rng.randrange(len(w)), rng.choice(letters)
            v = rng.choice([w[:p] + w[p + 1 :], w[:p] + c + w[p:], w[:p] + c + w[p + 1 :], w + c, c + w])
            if len(v) >= 5:
                counts[v] = rng.choice([3, 4, 8, 20, 41])
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    got = variants.variant_groups(df, Scratch(spark, "t"), shard_words=shard)
    assert sorted(map(tuple, got.select("word", "n", "n_near", "form", "form_n", "root").collect())) == brute_groups(counts)


def test_word_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(variants, "FLUSH", 50)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdÈüZ×") for _ in range(rng.randint(3, 8))) for _ in range(120)]
    docs = [(i, rng.choice([" ", "-", " 1 "]).join(rng.choice(words) for _ in range(rng.randint(0, 200)))) for i in range(80)]
    docs += [(80, None), (81, ""), (None, docs[0][1]), (3, docs[3][1]), (82, "日本語 wörter " * 3), (83, "q" * 20_000 + " " + "abcdef " * 50)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n long").repartition(3)
    want = brute_words(docs)
    assert dict(map(tuple, variants.word_counts(df).collect())) == want
    groups = variants.variant_groups(variants.word_counts(df))
    assert sorted(map(tuple, groups.select("word", "n", "n_near", "form", "form_n", "root").collect())) == brute_groups(want)
    assert variants.variant_groups(variants.word_counts(df.limit(0))).count() == 0
