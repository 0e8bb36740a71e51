"""Text operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echotable.llm import bpe, chat, jaccard, langid, lines, packing, pieces, pii, storage, suffix
from echotable.llm.storage import Scratch

DOCS = "doc_id long, text string, source string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    """Unique texts, exact copies, near copies of one base, shared passages, odd and empty texts."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(80).split(), text(40)
    rows = [(i, text(rng.randint(1, 90)) + "\n" + text(8)) for i in range(60)]
    for i in range(60, 110):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(i, rows[i % 7][1]) for i in range(110, 120)]
    rows += [(i, text(10) + " " + passage + " " + text(rng.randint(0, 30))) for i in range(120, 140)]
    rows += [(140, None), (141, ""), (142, " \n\t "), (143, "one two"), (144, "ONE  two"), (145, "é日本 😀"), (146, "x" * 3000), (3, rows[3][1])]
    return rows


def brute_classes(rows):
    sets = {}
    for d, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets[d] = max(sets.get(d, set()), s, key=len)
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("hot", [4096, 6])
def test_jaccard_equals_brute_force(spark, corpus, hot, monkeypatch):
    monkeypatch.setattr(jaccard, "FAMILY", 4096)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(frame(spark, corpus), sketch_bits=16, hot=hot).collect()}
    assert got == brute_classes(corpus)


def test_jaccard_verifies_in_rounds(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "SHIPPED", 0.3)
    wanted, sets = [], jaccard._sets_pass
    monkeypatch.setattr(jaccard, "_sets_pass", lambda *a: wanted.append(a) or sets(*a))
    rows = [*corpus, *((900 + d, t + " more") for d, t in corpus if t)]
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(frame(spark, rows), sketch_bits=16).collect()}
    assert got == brute_classes(rows) and len(wanted) > 2


def test_jaccard_without_rows_and_ids(spark):
    assert jaccard.jaccard_classes(frame(spark, [])).count() == 0
    assert [r.id for r in jaccard.jaccard_classes(frame(spark, [(None, "a b"), (1, "a b")])).collect()] == [1]


def test_word_ids_equal_the_tokenizer():
    enc = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "bc", " ", "  ", "\n", " \n", "\t", "é", "'s", "12", "!", "x y z", "<|endoftext|>"]) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts.append("a <|endoftext|> b")
    got = [x.tolist() for x in enc.batch(texts)]
    assert got == [e.ids for e in ref.encode_batch(texts, add_special_tokens=False)] and got[-1] == [64, 220, 50256, 275]


def test_packing_keeps_every_id_once(spark, corpus):
    pieces_ = packing.digest(packing.pack(frame(spark, corpus), window=64, shard_docs=40)).toPandas()
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {}
    for d, t in corpus:
        whole.setdefault(d, np.array(ref.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    for p in pieces_.itertuples():
        assert p.ids_crc32 == zlib.crc32(whole[p.doc_id if hasattr(p, "doc_id") else p.id][p.start : p.start + p.length].tobytes())
    covered = pieces_.groupby("id").length.sum()
    assert covered[3] == 2 * len(whole[3])  # a repeated row has pieces of its own
    assert all(covered[d] == len(v) for d, v in whole.items() if d != 3)
    for _, s in pieces_.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 64
    sums = pieces_.groupby("sequence_id").length.sum()
    assert (sums < 64).sum() <= 8
    assert packing.pack(frame(spark, [])).count() == 0


def test_pieces_equal_the_library(spark, corpus, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    m, ref = pieces.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "ß", "日本", "x", "aa", "er", "tion", "1", "▁", "😀", " and"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    assert [m.encode(t) for t in texts] == [ref.encode(t) for t in texts]
    monkeypatch.setattr(pieces, "CHUNK", 40)  # nearly all texts are giant
    rows = [(i, t) for i, (_, t) in enumerate(corpus)]
    got = {r.doc_id: r for r in pieces.decode(pieces.encode(frame(spark, rows))).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert list(got[i].ids) == ref.encode(t or "") and got[i].decoded == (t or "")


def test_chat_keeps_maximal_conversations(spark):
    turns = [(1, 0, "u", "hi"), (1, 1, "a", "yo"), (2, 0, "u", "hi"), (3, 0, "u", "hi"), (3, 1, "a", "yo"), (4, 0, "u", "ho"), (5, 0, None, None), (None, 0, "u", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.text) for r in chat.render(df).collect()}
    assert set(got) == {1, 4, 5, None}
    assert got[1] == (2, "<|u|>\nhi<|end|>\n<|a|>\nyo<|end|>\n") and got[5][1] == "<|" + "|>\n<|end|>\n"
    assert chat.render(df.limit(0)).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_dedup(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    long = [word() for _ in range(150)]
    near = list(long)
    near[70] = "other"
    rows = [(1, " ".join(long) + "\nalpha beta"), (2, "Alpha beta\nkept line here\n\n"), (3, " ".join(near)), (4, None), (5, ""), (6, "unlike\n\nanything"), (7, "alpha beta\nalpha beta"), (None, "alpha beta")]
    got = {r.doc_id: r for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "kept line here\n\n" and got[4].text is None and got[5].text == ""
    assert got[7].text == "" and got[7].n_removed == 2 and got[6].n_removed == 0 and got[None].n_removed == 0
    assert got[3].text == ""  # one word of 150 differs
    assert levenshtein(" ".join(long), " ".join(near)) <= 0.2 * len(" ".join(long))
    assert lines.dedup_lines(frame(spark, [])).count() == 0


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def edit_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@pytest.mark.parametrize("n_words", [3, 8, 15, 30])
def test_line_dedup_finds_lines_of_edit_similarity(spark, n_words):
    """Against brute force: one replaced word, or one character in ten, in lines of unlike words."""
    rng = random.Random(n_words)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    texts = []
    for i in range(60):
        words = [word() for _ in range(n_words)]
        texts.append(" ".join(words))
        if i % 2:
            words[rng.randrange(n_words)] = word()
            texts.append(" ".join(words))
        else:
            chars = list(texts[-1])
            for at in rng.sample(range(len(chars)), max(1, len(chars) // 10)):
                chars[at] = rng.choice("abcdefghijklmnopqrstuvwxyz")
            texts.append("".join(chars))
    want = {i for i in range(1, len(texts), 2) if edit_distance(texts[i - 1], texts[i]) <= 0.2 * max(len(texts[i - 1]), len(texts[i])) and texts[i - 1] != texts[i]}
    got = {r.doc: r.first_doc for r in lines.repeated_lines(frame(spark, list(enumerate(texts)))).collect()}
    # indices 1, 5, 9 ... have scattered characters, 3, 7, 11 ... one replaced word
    for kind, least in ((1, 0.35), (3, 0.9)):
        some = {i for i in want if i % 4 == kind}
        assert n_words == 3 and kind == 3 or len(some) >= 20
        assert len(some & set(got)) >= least * len(some)
    for i, first in got.items():
        assert edit_distance(texts[i], texts[first]) <= 0.2 * max(len(texts[i]), len(texts[first]))


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice(["a", "b", "@", ".", "-", "+", "1", "25", "4444", " ", "(", ")", "é", "%", "4111111111111111", "1.2.3.4"]) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == plain_spans(t)


def test_field_adds_consistent_mentions(spark):
    t = "Call +1 (886) 555-7964 or mail jo.doe7@x.example.com now. Later call (886) 555-7964, user jo.doe7 said 8865557964; not 1234567890."
    added = pii.add_spans(t, pii.base_spans(t), pii.default_potentials())
    assert [(pii.KINDS[k], t[a:b]) for k, a, b in added] == [("phone", "(886) 555-7964"), ("email", "jo.doe7"), ("phone", "8865557964")]
    assert pii.add_spans("1234567890 again 1234567890", [], pii.default_potentials()) == []
    df = frame(spark, [(1, t), (2, None), (3, "")])
    r = {x.doc_id: x for x in pii.digest(df, pii.fit(df)).collect()}
    assert (r[1].n_email, r[1].n_phone, r[2].n_email) == (1, 1, 0) and r[2].spans == "" and r[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert "555" not in pii.mask(df, pii.fit(df)).where("doc_id = 1").first().text


def brute_repeats(rows, length=50):
    first, texts = {}, [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in texts:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup_joins_places_where_a_bitmap_would_be_too_full(spark, corpus, monkeypatch):
    monkeypatch.setattr(suffix, "FILL", 1 << 40)
    rng = random.Random(6)
    base = ["".join(rng.choice("abé \n") for _ in range(300)) for _ in range(4)]
    cut = lambda b, i: b[i : i + rng.randint(50, 200)]
    rows = [*corpus, *((d if d % 7 else d // 2, "".join(cut(b, rng.randint(0, 200)) for b in rng.choices(base, k=3))) for d in range(200, 260))]
    rows += [(2**60 + d, rows[-d][1]) for d in range(1, 20)]  # ids that a double can't hold
    got = sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix.remove_repeats(frame(spark, rows)).collect())
    assert got == brute_repeats(rows)


@pytest.mark.parametrize("block", [700, 1 << 20])
def test_suffix_dedup_equals_brute_force(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", block)
    rng = random.Random(4)
    base = ["".join(rng.choice("abé \n") for _ in range(300)) for _ in range(4)]
    rows = list(corpus)
    for d in range(200, 320):
        parts = [b[i : i + rng.randint(0, 140)] for b in rng.choices(base, k=rng.randint(0, 5)) for i in [rng.randint(0, 290)]]
        rows.append((d if d % 7 else d // 2, rng.choice(["x", "yy", ""]).join(parts) if d % 11 else None))
    got = sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix.remove_repeats(frame(spark, rows)).collect())
    assert got == brute_repeats(rows)


def test_language_blocks_count_each_ngram_once(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 7)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.choice([0, 1, 2, 6, 7, 8, 14, 30]))) for _ in range(40)]
    seen = np.zeros(len(texts), int)
    for _, index in langid.ngram_blocks(texts, (1, 2, 3), 16):
        np.add.at(seen, index, 1)
    assert seen.tolist() == [sum(max(0, len(t) - n + 1) for n in (1, 2, 3)) for t in texts]


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(d.where("doc_id % 3 <> 1"))
    held = langid.identify(d.where("doc_id % 3 = 1"), model)
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()
    odd = {r.doc_id: r for r in langid.identify(frame(spark, [(1, None), (2, ""), (3, "12 !?"), (4, "x")]), model).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and odd[1].score == 0 and odd[4].lang_pred in model.names
    none = langid.fit(d.limit(0))
    assert langid.identify(d.limit(2), none).first().lang_pred == "und"


def test_line_dedup_without_spaces_and_with_punctuation(spark):
    rng = random.Random(3)
    signs = "".join(chr(rng.randrange(0x4E00, 0x5600)) for _ in range(40))
    url = "https://example.org/path/to/some/long/page-number-one"
    rows = [(1, signs), (2, signs[:20] + "x" + signs[21:]), (3, url), (4, url[:25] + "z" + url[26:]), (5, "We reached the end."), (6, "we reached the end\t\r"), (7, "unlike all others")]
    got = {r.doc: r.first_doc for r in lines.repeated_lines(frame(spark, rows)).collect()}
    assert got == {2: 1, 4: 3, 6: 5}


def test_columns_that_clash_are_kept(spark):
    """Own columns named like those that the operators use inside, and empty tables."""
    from echotable.llm import curate

    names = ["row", "gone", "hit", "_gone", "doc", "slot", "part", "held", "ids2", "key", "_pii", "norm"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    text = "alpha beta gamma delta epsilon zeta eta theta\nmail jo.doe7@x.example.com now"
    rows = [(i, text if i else None, "en", "s", 5, *[f"{n}{i}" for n in names]) for i in range(3)]
    df = spark.createDataFrame(rows, schema).repartition(2)
    for stage in (curate.line_stage, curate.near_duplicate_stage, curate.privacy_stage):
        out = stage(df)
        assert out.columns == df.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)
        assert stage(df.limit(0)).count() == 0
    ids = pieces.encode(df)
    assert ids.columns == [*df.columns, "ids"] and {r.row for r in ids.collect()} == {"row0", "row1", "row2"}
    assert pieces.encode(df.limit(0)).count() == 0 and langid.identify(df.limit(0), langid.fit(df)).count() == 0
    assert {r.lang_pred for r in langid.identify(frame(spark, [(1, "\u00bd \u00b2"), (1, "\u00bd \u00b2")]), langid.fit(df)).collect()} == {"und"}


def test_matrices_combine_in_any_order():
    """The pairwise product of a text's matrices equals the fold from left to right, for a unigram-like model too."""
    m = pieces.Model(public_tokenizers.path("piece_bpe_32k.model"))
    z = pieces.escaped("thisisoneverylongwordwithoutanyspaceinside" * 3)
    cuts = list(range(0, len(z), 31)) + [len(z)]
    made = []
    for k, (c0, c1) in enumerate(zip(cuts, cuts[1:])):
        lo = max(0, c0 - m.longest)
        lefts, rights, w = pieces.transfer(m, z[lo : c1 + m.longest], c0 - lo, c1 - lo, k == 0)
        made.append({"row": 0, "chunk": k, "lefts": lefts, "rights": rights, "weights": w.ravel()})
    import pandas as pd

    level = made
    while len(level) > 1:
        level = [pieces._combine(pd.DataFrame(level[i : i + 2])).iloc[0].to_dict() for i in range(0, len(level), 2)]
    _, rights, w = pieces._matrix(pd.Series(level[0]))
    fold = {e: v for e, v in zip(made[0]["rights"], np.asarray(made[0]["weights"]))}
    for x in made[1:]:
        a = np.asarray(x["weights"]).reshape(len(x["lefts"]), len(x["rights"]))
        came = np.array([fold.get(tuple(e), -np.inf) for e in x["lefts"]])
        fold = dict(zip(map(tuple, x["rights"]), (came[:, None] + a).max(0)))
    assert {e: v for e, v in zip(rights, w[0])} == fold


def test_line_dedup_finds_lines_on_both_sides_of_every_length_rule(spark):
    rng = random.Random(1)
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    pairs = []
    for size in (250, 250, 250, 230, 300):  # one inserted word takes many of them over the length at which rarity changes
        for _ in range(12):
            w = []
            while len(" ".join(w)) < size:
                w.append(word(3, 8))
            w = " ".join(w)[:size].split()
            k = rng.randrange(len(w))
            pairs.append((" ".join(w), " ".join(w[:k] + [word(11, 11)] + w[k:])))
    found = {(r.first_doc, r.doc) for r in lines.repeated_lines(frame(spark, list(enumerate(t for p in pairs for t in p)))).collect()}
    assert {(2 * i, 2 * i + 1) for i in range(len(pairs))} <= found


def test_line_dedup_finds_pairs_of_one_template(spark):
    rng = random.Random(2)
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    shared, pairs = [word(10, 12) for _ in range(5)], []
    for _ in range(120):
        own = [word(3, 5) for _ in range(12)]
        a = shared[:3] + own[:6] + shared[3:] + own[6:]
        b = list(a)
        b[rng.choice([3, 4, 5, 6, 7, 12, 13])] = word(3, 5)
        pairs.append((" ".join(a), " ".join(b)))
    found = {(r.first_doc, r.doc) for r in lines.repeated_lines(frame(spark, list(enumerate(t for p in pairs for t in p)))).collect()}
    assert found == {(2 * i, 2 * i + 1) for i in range(len(pairs))}


@pytest.mark.parametrize("block", [8, 256])
def test_line_dedup_compares_all_lines_of_a_crowded_key(spark, monkeypatch, block):
    """Lines of one template whose copies differ in all their long words of their own, and equal lines of shorter ones."""
    monkeypatch.setattr(lines, "BLOCK", block, raising=False)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    shared, pairs = [word(11) for _ in range(5)], []
    for _ in range(60):
        short = [word(3) for _ in range(28)]
        pairs.append([" ".join(shared + [word(6) for _ in range(6)] + short) for _ in range(2)])
    texts = [t for p in pairs for t in p]
    alike = lambda a, b: edit_distance(a, b) <= 0.2 * max(len(a), len(b))
    assert all(alike(*p) for p in pairs) and not any(alike(p[0], q[1]) for p, q in zip(pairs, pairs[1:]))
    found = {(r.first_doc, r.doc) for r in lines.repeated_lines(frame(spark, list(enumerate(texts)))).collect()}
    assert found == {(2 * i, 2 * i + 1) for i in range(len(pairs))}


def test_scratch_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for d in disk.localDirsString() for f in Path(d).rglob("shuffle_*.data")}
    made = files()
    saved = Scratch(spark, "test").save(spark.range(1000).repartition(3))
    until = time.time() + 10
    while files() - made and time.time() < until:
        time.sleep(0.1)
    assert not files() - made
    assert saved.count() == 1000 and spark.conf.get(storage.CLEANUP, None) in (None, "false")


def test_column_names_with_dots(spark):
    from echotable.llm import curate

    docs = spark.createDataFrame([(i, f"some plain words of text number {i} and a line\nanother line {i}", "en", "s", 9, i) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long, `a.b` long")
    for stage in (curate.language_stage, curate.line_stage, curate.near_duplicate_stage, curate.privacy_stage):
        assert stage(docs).columns == docs.columns
    ids = pieces.encode(docs)
    assert pieces.decode(ids).columns == [*ids.columns, "decoded"]


def test_added_tokens_are_looked_for_once_a_text():
    class Counted(list):
        n = 0

        def __iter__(self):
            Counted.n += 1
            return super().__iter__()

    enc = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert enc.added
    enc.added = enc.words.added = Counted(enc.added)
    plain = [" ".join(f"word{i}x{j}" for j in range(50)) for i in range(4)] + ["", None, "two  spaces", "a \n b"]
    for text, ids in zip(plain, enc.batch(plain)):
        assert ids.tolist() == enc.model.encode(text or "", add_special_tokens=False).ids
    assert Counted.n <= 2 * len(plain)
    marked = [f"some wo{enc.added[0]}rds here", f"{enc.added[0]} first", f"last {enc.added[0]}"]
    for text, ids in zip(marked, enc.batch(marked)):
        assert ids.tolist() == enc.model.encode(text, add_special_tokens=False).ids


def test_words_are_cut_where_no_piece_holds_both_characters(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    m, ref = pieces.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    scanned = []
    one = m.word
    monkeypatch.setattr(m, "word", lambda w: scanned.append(w) or one(w))
    texts = ["the reading,\nThe reading.", "the\nreading\tThe reading!\nthe 日本\nreading"]
    assert [m.encode(t) for t in texts] == [ref.encode(t) for t in texts]
    assert len(scanned) == len(set(scanned)) and scanned.count("▁reading") == 1 and not any("\n" in w and len(w) > 1 for w in scanned)
    assert m.pieces("▁the▁reading,▁▁The\n") == ref.encode("the reading,  The\n")
    assert len(scanned) == len(set(scanned))  # a chunk of a giant text uses what is remembered


def test_line_dedup_offers_no_pair_whose_letters_differ_too_much(spark):
    """What a line has to spare is counted right, and is never more than the edit distance."""
    rng = random.Random(23)
    texts = ["".join(rng.choice("abcdefghijklmnop qrstuvwxyz.é") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    close = []
    for t in texts:
        for _ in range(rng.randint(0, len(t) // 5)):
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(["", rng.choice("eéz"), t[at : at + 1] + "x"]) + t[at + 1 :]
        close.append(t)
    other = close[1:] + close[:1]
    rows = spark.createDataFrame([(a, b, c) for a, b, c in zip(texts, close, other)], "a string, b string, c string")
    held = rows.select("a", "b", "c", *[F.struct(*lines._bags(F.col(x))).alias(f"m{x}") for x in "abc"])
    got = held.select("a", "b", "c", lines._to_spare("ma", "mb").alias("ab"), lines._to_spare("mb", "ma").alias("ba"), lines._to_spare("ma", "mc").alias("ac")).collect()

    def spare(a, b):
        kind = lambda t: Counter(c if c in lines.LETTERS else "rest" for c in t)
        return sum((kind(a) - kind(b)).values())

    assert all(r.ab == spare(r.a, r.b) and r.ba == spare(r.b, r.a) and r.ac == spare(r.a, r.c) for r in got)
    assert all(max(r.ab, r.ba) <= levenshtein(r.a, r.b) for r in got)


def test_line_dedup_bounds_the_distance_of_lengthy_lines_by_pieces(spark):
    """A passage put in, taken out or repeated must not make a sum of pieces that is below the distance."""
    rng = random.Random(29)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    rows = []
    for n in (90, 160, 300):
        for kind in range(4):
            a = [word() for _ in range(n)]
            b = [word() if rng.random() < 0.05 else w for w in a]
            if kind == 1:
                b[n // 2 : n // 2] = [word() for _ in range(n // 9)]
            elif kind == 2:
                del b[n // 3 : n // 3 + n // 9]
            elif kind == 3:
                a, b = a[: n // 2] + ["edon,"] * (n // 2), b[: n // 2] + ["edon,"] * (n // 2 + 9)
            rows.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "ta string, tb string").select("*", F.char_length("ta").alias("la"), F.char_length("tb").alias("lb"))
    df = df.withColumn("n", F.greatest("la", "lb")).withColumn("most", F.expr("cast(floor(0.2 * n) as int)"))
    got = df.select("ta", "n", "most", F.expr(lines._pieces_apart()).alias("sum"), F.expr("levenshtein(ta, tb)").alias("d")).collect()
    assert all(r.d <= r["sum"] or r["sum"] > r.most for r in got)
    varied = [r for r in got if "edon" not in r.ta]  # a repeated word has too many places
    assert len(varied) == 9 and all(r["sum"] <= r.most for r in varied)
