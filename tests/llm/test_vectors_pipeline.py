"""Vector operators and the pipeline against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from echotable.llm import ann, langid, neardup, packing, pii
from echotable.llm.jaccard import jaccard_classes
from tests.llm.test_text_ops import brute_classes


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 16))
    rows = [(i, [float(x) for x in base[i]], int(i % 3)) for i in range(400)]
    for i in range(400, 700):
        rows.append((i, [float(x) for x in base[i % 20] + rng.normal(size=16) * 0.08], int(i % 20 % 3)))
    rows += [(i, rows[5][1], 2) for i in range(700, 760)]
    rows += [(760, None, 1), (761, [0.0] * 16, 1), (762, [float("nan")] + [1.0] * 15, 1), (763, [None] + [1.0] * 15, 1), (764, [1.0] * 16, None), (765, [float("inf")] * 16, 1), (750, rows[5][1], 2)]
    return spark.createDataFrame([(i, v, k, "x") for i, v, k in rows], "vec_id long, embedding array<double>, label int, extra string").repartition(3), rows


def clean(rows):
    good = {i: (np.array(v), k) for i, v, k in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(good))
    x = np.array([good[i][0] for i in ids])
    return ids, x / np.linalg.norm(x, axis=1, keepdims=True), np.array([-1 if good[i][1] is None else good[i][1] for i in ids])


@pytest.mark.parametrize("block", [64, 1024])
def test_near_duplicates_equal_brute_force(vectors, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    df, rows = vectors
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df, cell_rows=50).collect()}
    ids, x, label = clean(rows)
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None, :]) & (label >= 0)[:, None]
    np.fill_diagonal(link, False)
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], comp[:, None]).min(1))
        if (new == comp).all():
            break
        comp = new
    for i, n, c in zip(ids.tolist(), link.sum(1).tolist(), comp.tolist()):
        assert got[i] == (n, c, i == c)
    assert got[760] == (0, 760, True) and len(got) == 766
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_pairs_meet_at_midpoints_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 40)
    monkeypatch.setattr(neardup, "DEALT", 1)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    x = np.repeat(base, 6, axis=0) + rng.normal(size=(360, 16)) * 0.1
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = {r.id: r.n_links for r in neardup.near_duplicates(df, cell_rows=20).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    label = np.arange(360) % 2
    link = (u @ u.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    assert got == dict(enumerate(link.sum(1).tolist())) and link.sum() > 100


def test_nearest_neighbours_recall(vectors):
    df, rows = vectors
    got = ann.nearest(df, df.where("vec_id % 10 = 0")).toPandas()
    ids, x, _ = clean(rows)
    place = {i: k for k, i in enumerate(ids.tolist())}
    hits = total = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[place[q]]
        s[place[q]] = -9
        want = ids[np.lexsort((ids, -np.round(s, 12)))][:5]
        hits, total = hits + len(set(want) & set(g["id"])), total + 5
        g = g.sort_values("rank")
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(g.score, s[[place[i] for i in g["id"]]], atol=1e-12)
    assert set(got.query_id) == {i for i in ids.tolist() if i % 10 == 0} and hits >= 0.9 * total
    assert ann.nearest(df.limit(0), df).count() == 0


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "12 34", "en", "s", 5)], docs.schema)
    rows = docs.unionByName(extra).collect()
    kept = {r.doc_id: r.text for r in rows}

    now = docs.unionByName(extra)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "personal_data", "packing"]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, None).write.parquet(f"{tmp_path}/{n}")
        after = spark.read.parquet(f"{tmp_path}/{n}")
        got = {r.doc_id: r for r in after.collect()} if name != "packing" else None
        before = {r.doc_id: r for r in now.collect()}
        if name != "packing":
            assert after.columns == docs.columns
        if name == "language_id":
            assert set(got) == {d for d, t in kept.items() if t and any(c.isalpha() for c in t)}
        elif name == "line_dedup":
            seen = set()  # exact copies of lines of earlier documents go at least
            for d in sorted(before):
                own = [line.strip().lower() for line in before[d].text.split("\n") if line.strip()]
                left = [line.strip().lower() for line in got[d].text.split("\n")] if d in got else []
                assert not seen & set(left) and all(left.count(k) <= 1 for k in own)
                seen |= set(own)
            assert all(set(r.text.split("\n")) <= set(before[d].text.split("\n")) for d, r in got.items())
            first = min(before)
            assert got[first].text == before[first].text
        elif name == "ngram_jaccard":
            classes = brute_classes([(d, r.text) for d, r in before.items()])
            assert set(got) == {d for d, (_, c) in classes.items() if d == c}
        elif name == "personal_data":
            assert set(got) == set(before)
            for d, r in got.items():
                assert (r.text == before[d].text) == (not pii.base_spans(before[d].text)) and not pii.base_spans(r.text)
                assert r.n_chars == len(r.text)
        else:
            pieces = after.toPandas()
            whole = {r.id: r.n for r in packing.pack(now).groupBy("id").agg((F.sum(F.octet_length("ids")) / 2).alias("n")).collect()}
            assert pieces.groupby("doc_id").length.sum().to_dict() == whole
        now = after


def test_tables_of_copies(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(i, text) for i in range(500)], "doc_id long, text string").repartition(7)
    assert {r.component_id for r in jaccard_classes(df).collect()} == {0}
    model = langid.LanguageModel([], np.zeros(0), np.zeros((0, 0)), (1,), 4)
    assert langid.identify(df, model).where("lang_pred = 'und'").count() == 500


def test_nearest_neighbours_of_equal_scores(spark):
    """All cosines are equal: the smaller ids are the nearest."""
    rows = [(i, [float(x * (i + 1)) for x in (1, 2, 3)], 0) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = ann.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert len(got) == 5 and all(abs(r.score - 1) < 1e-12 for r in got)
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    exact = sorted(((-ann.cosines(np.array([v]), np.array([rows[0][1]]))[0], i) for i, v, _ in rows[1:]))[:5]
    assert [r.id for r in got] == [i for _, i in exact]


def test_language_scores_equal_plain_bayes(spark):
    """Predictions and posteriors against a direct computation over the same n-grams."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(d)
    texts = {r.doc_id: r.text for r in d.limit(40).collect()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d, model).collect()}
    for i, t in texts.items():
        score = model.prior.copy()
        for at, _ in langid.ngram_blocks([(t or "").lower()], model.orders, model.bits):
            score += model.logp[:, at].sum(1)
        p = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        assert got[i][0] == model.names[int(p.argmax())] and abs(got[i][1] - p.max()) < 1e-9
