"""Exact order statistics and as-of lookups against plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from echotable.operators import select as X


@pytest.mark.parametrize("bins,most", [(1024, 10_000), (64, 3)])
def test_ranks_equal_sorted_lists(spark, bins, most):
    rng = random.Random(1)
    groups = {
        "even": [rng.random() for _ in range(300)], "same": [7.5] * 50, "two": [1.0] * 40 + [2.0] * 41, "wide": [10.0 ** rng.randint(-8, 8) * rng.choice([1, -1]) for _ in range(60)],
        "one": [3.0], None: [float(rng.randint(0, 5)) for _ in range(90)], "edge": [-1.7e308, 1.7e308, 0.0, 5e-324],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("even", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    n = F.col("n")
    got = {(r.g, r.name): (r.n, r.value) for r in X.at_ranks(df, ["g"], "v", {"first": F.lit(1), "p95": F.ceil(n * 0.95), "mid": F.ceil(n / 2), "past": n + 1}, bins, most).collect()}
    want = {}
    for g, vs in groups.items():
        vs = sorted(vs)
        for name, at in (("first", 1), ("p95", math.ceil(len(vs) * 0.95)), ("mid", math.ceil(len(vs) / 2))):
            want[g, name] = (len(vs), vs[at - 1])
    assert got == want


def test_summary(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 11)] + [("b", 5.0)], "g string, v double")
    got = {r.g: (r.n, r.median, r.p95, r["max"]) for r in X.summary(df, "g", "v").collect()}
    assert got == {"a": (10, 5.5, 10.0, 10.0), "b": (1, 5.0, 5.0, 5.0)}
    assert X.summary(df.limit(0), "g", "v").count() == 0


@pytest.mark.parametrize("bucket", [3, 50_000])
def test_as_of_equals_a_scan(spark, bucket):
    rng = random.Random(2)
    known = [(rng.choice(["hot"] * 5 + ["a", None]), rng.randint(0, 300), i) for i in range(200)] + [("hot", None, 900), ("hot", 40, 901), ("hot", 40, 902)]
    asked = [(i, rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([None, *range(-20, 320)])) for i in range(300)] + [(0, "hot", 40), (0, "hot", 40)]
    k = spark.createDataFrame(known, "k string, t long, id long").withColumn("t", F.timestamp_seconds("t"))
    a = spark.createDataFrame(asked, "row long, k string, t long").withColumn("at", F.timestamp_seconds("t"))
    got = X.as_of(a, k, ["k"], "at", "t", ["id"], "id", bucket)
    assert got.columns == ["row", "k", "t", "at", "id"]
    want = []
    for row, key, t in asked:
        found = [(u, i) for name, u, i in known if key is not None and name == key and t is not None and u is not None and u <= t]
        want.append((row, key, t, max(found)[1] if found else None))
    assert sorted(map(repr, want)) == sorted(repr((r.row, r.k, r.t, r.id)) for r in got.collect())
    assert X.as_of(a.limit(0), k, ["k"], "at", "t", ["id"], "id").count() == 0
    assert X.as_of(a, k.limit(0), ["k"], "at", "t", ["id"], "id").where("id is not null").count() == 0
