"""Review decisions, stratified group folds and member subsets against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotable.operators import decisions as Y
from echotable.operators import folds as K
from echotable.operators import training as T


def test_requests_are_checked_and_the_first_good_one_holds(spark):
    rows = [
        (1, 10, 5, "override", "", "Gunshot", None, "comments_required"), (2, 10, 6, "override", "x", None, None, "final_class_required"), (3, 10, 7, "Override ", "x", "Thunder", None, "unknown_class"),
        (4, 10, 8, "override", "x", "Gunshot", "High", None), (5, 10, 9, "reject", "x", None, None, "already_decided"), (6, 11, 1, "confirm", None, "ignored", None, None), (7, 11, 1, "confirm", None, None, None, "already_decided"),
        (8, 12, 1, "reject", "noise", None, "Huge", "unknown_severity"), (9, 12, 2, "reject", "noise", None, None, None), (10, 13, 1, "confirm", None, None, None, "already_decided"), (11, 99, 1, "confirm", None, None, None, "no_such_review"),
        (12, 14, 1, None, None, None, None, "unknown_decision"), (13, 10, 9, "maybe", None, None, None, "already_decided"),
    ]
    a = spark.createDataFrame([(*r[:7], None) for r in rows], "action_id long, review_id long, at long, decision string, comments string, final_class string, final_severity string, false_alarm boolean")
    r = spark.createDataFrame([(10, 1, "Pending Review", "Siren"), (11, 2, "Pending Review", "Siren"), (12, 3, "Pending Review", "Siren"), (13, 4, "Reviewed", "Siren"), (14, 5, "Pending Review", "Siren")], "review_id long, event_id long, status string, original_class string")
    applied = Y.apply_decisions(a, r)
    assert {x.action_id: x.error for x in applied.collect()} == {x[0]: x[7] for x in rows}
    done = {x.review_id: (x.status, x.decision, x.final_class, x.false_alarm) for x in Y.decided(r, applied).collect()}
    assert done == {10: ("Reviewed", "override", "Gunshot", False), 11: ("Reviewed", "confirm", "Siren", False), 12: ("Reviewed", "reject", None, True), 13: ("Reviewed", None, None, None), 14: ("Pending Review", None, None, None)}
    e = spark.createDataFrame([(1, True), (5, True), (6, True), (2, False)], "event_id long, requires_manual_review boolean")
    assert {x.event_id: x.requires_manual_review for x in Y.cleared(e, Y.decided(r, applied)).collect()} == {1: False, 5: True, 6: True, 2: False}


def spread(counts):
    return (counts / counts.sum(0)).std(0).mean()


def plain_folds(groups, k):
    """One group after the other, most uneven first, to the fold after which class shares vary least."""
    total, held, out = sum(groups.values()), np.zeros((k, len(next(iter(groups.values()))))), {}
    for g in sorted(groups, key=lambda g: (-groups[g].std(), -groups[g].sum(), g)):
        tries = []
        for f in range(k):
            new = held.copy()
            new[f] += groups[g] / total
            tries.append((round(new.std(0).mean(), 12), round(held[f].sum(), 12), f))
        f = min(tries)[2]
        held[f] += groups[g] / total
        out[g] = f
    return out


def test_folds_spread_no_worse_than_group_by_group(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows = [(f"g{g}", c) for g in range(120) for c, n in zip("abcd", (rng.choice([0, 0, 3]), rng.choice([1, 2]), rng.choice([0, 1]), rng.choice([0, 0, 0, 9]))) for _ in range(n)]
        df = spark.createDataFrame(rows, "g string, c string").repartition(3)
        got = K.stratified_folds(df, "g", "c", 5).collect()
        assert len(got) == len(rows)
        fold = {r.g: r.fold for r in got}
        assert len({(r.g, r.fold) for r in got}) == len(fold) and set(fold.values()) == set(range(5))
        groups = {g: np.array([sum(1 for x, c in rows if x == g and c == k) for k in "abcd"], float) for g in fold}
        table = lambda of: np.array([sum((groups[g] for g in groups if of[g] == f), np.zeros(4)) for f in range(5)])
        assert spread(table(fold)) <= 1.1 * spread(table(plain_folds(groups, 5))) + 0.002
    again = {r.g: r.fold for r in K.stratified_folds(df.repartition(7), "g", "c", 5).collect()}
    assert again == fold
    small = {r.g: r.fold for r in K.stratified_folds(df, "g", "c", 5, signatures=4).collect()}
    assert spread(table(small)) < 0.1
    odd = spark.createDataFrame([(None, "a"), (None, None), ("x", "a")], "g string, c string")
    assert K.stratified_folds(odd, "g", "c", 2).count() == 3 and K.stratified_folds(odd.limit(0), "g", "c", 2).count() == 0


def test_member_subsets_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(0, 3)), *[[float(x) for x in rng.integers(0, 4, 3)] for _ in range(4)]) for _ in range(200)]
    schema = "y int, a array<double>, b array<double>, c array<double>, d array<double>"
    df = spark.createDataFrame([*rows, (1, None, *rows[0][2:]), (7, *rows[0][1:])], schema).withColumn("y", F.col("y").cast("string")).repartition(3)
    got = {r.mask: (r.size, r.right, r.clips, r.place) for r in T.member_subsets(df, list("abcd"), "y", ["0", "1", "2"]).collect()}
    want = []
    for mask in range(1, 16):
        right = sum(int(np.argmax(sum(np.array(r[1 + i]) for i in range(4) if mask >> i & 1)) == r[0]) for r in rows)
        want.append((-right, bin(mask).count("1"), mask))
    assert got == {m: (size, -right, 200, place) for place, (right, size, m) in enumerate(sorted(want), 1)}
    assert T.member_subsets(df.limit(0), ["a"], "y", ["0", "1", "2"]).count() == 0
    with pytest.raises(ValueError):
        T.member_subsets(df, [], "y", ["0"])
