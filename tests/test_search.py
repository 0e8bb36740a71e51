"""Substring search by trigrams against plain Python."""

from __future__ import annotations

import random

from echotable.operators import search as R


def test_found_rows_equal_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 16)
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abAB é\n%_") for _ in range(rng.randint(0, 40))), rng.choice([None, "Mic", "upload"])) for i in range(120)] + [(7, "abc", None), (None, "abab", "x"), (200, None, None), (201, "", "")]
    df = spark.createDataFrame(rows, "id long, a string, b string").repartition(3)
    R.build(df, "id", ["a", "b"], f"{tmp_path}/i")
    for text in ("aba", "ABab", "é", "", "mic", "loa", "%_", "a\nb", "zzz", "ab é", "micx"):
        got = sorted(repr(tuple(r)) for r in R.containing(df, "id", ["a", "b"], text, f"{tmp_path}/i").collect())
        want = [r for r in rows if any(c is not None and text.lower() in c.lower() for c in r[1:])]
        if len(text) > 2:
            want = [r for r in want if r[0] is not None]
        assert got == sorted(map(repr, want)), text


def test_a_search_reads_the_postings_of_its_trigrams(spark, tmp_path):
    df = spark.range(300).selectExpr("id", "concat('text number ', id, ' of many') AS a")
    R.build(df, "id", ["a"], f"{tmp_path}/i")
    plan = R.candidates(spark, f"{tmp_path}/i", "number 123")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
    assert sorted(r.key for r in R.candidates(spark, f"{tmp_path}/i", "number 123").collect()) == [123]
