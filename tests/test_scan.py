"""Folds in parts against the same folds row by row, on random logs with hot sessions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotable.operators import ordered as O
from echotable.operators import scan


def streaks(rows, needed, seconds):
    kind, n, last, fired, out = None, 0, 0.0, False, []
    for c, ok, t in rows:
        if not ok:
            kind, n, fired = None, 0, False
            out.append((0, False, False))
            continue
        if kind != c or (n and t - last > seconds):
            n, fired = 0, False
        n += 1
        newly = not fired and n >= needed
        out.append((n, fired or newly, newly))
        kind, last, fired, n = c, t, fired or newly, 0 if newly else n
    return out


def limited(times, most, seconds):
    kept, out = [], []
    for t in times:
        ok = sum(x > t - seconds for x in kept) < most
        kept += [t] * ok
        out.append(ok)
    return out


def locked(rows, failures, seconds):
    streak, until, locks, refused = 0, float("-inf"), 0, 0
    for t, bad in rows:
        if t < until:
            refused += 1
        elif bad:
            streak += 1
            if streak >= failures:
                streak, until, locks = 0, t + seconds, locks + 1
        else:
            streak = 0
    return locks, refused


def split_runs(how, columns, cuts):
    """A fold over pieces, its state handed on."""
    state, out = how.start, []
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            got, state = how.run(state, *[c[a:b] for c in columns])
            out.append(got)
    return {k: np.concatenate([o[k] for o in out]) for k in out[0]}, state


@pytest.mark.parametrize("needed", [1, 2, 3, 5])
def test_streaks_in_pieces_and_by_effects(needed):
    rng = random.Random(needed)
    how = scan.Streaks(needed, 5)
    for _ in range(300):
        n = rng.randint(1, 40)
        t = np.cumsum([rng.choice([1, 1, 2, 6]) for _ in range(n)]).astype(float)
        c = np.array([rng.choice("AAAAAB") for _ in range(n)], object)
        ok = np.array([rng.random() < 0.93 for _ in range(n)])
        cuts = [0, *sorted(rng.randint(0, n) for _ in range(rng.randint(0, 6))), n]
        got, state = split_runs(how, [np.zeros(n), t, c, ok], cuts)
        want = streaks(zip(c, ok, t), needed, 5)
        assert list(zip(*[got[k].tolist() for k in ("consecutive", "confirmed", "newly_confirmed")])) == want
        told = how.start
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                told = how.after(how.effect(np.zeros(b - a), t[a:b], c[a:b], ok[a:b]), told)
        assert told[0] == state[0] and (told[0] is False or told == state)


def test_limits_and_locks_in_pieces():
    rng = random.Random(2)
    for _ in range(300):
        n, most, failures = rng.randint(1, 60), rng.randint(1, 4), rng.randint(1, 4)
        t = np.cumsum([rng.choice([0, 1, 1, 2, 9]) for _ in range(n)]).astype(float)
        bad = np.array([rng.random() < 0.7 for _ in range(n)])
        cuts = [0, *sorted(rng.randint(0, n) for _ in range(rng.randint(0, 6))), n]
        assert split_runs(scan.RateLimit(most, 7), [np.zeros(n), t], cuts)[0]["allowed"].tolist() == limited(t.tolist(), most, 7)
        got = split_runs(scan.Lockouts(failures, 4), [np.zeros(n), t, bad], cuts)[0]
        assert (got["locked"].sum(), got["refused"].sum()) == locked(zip(t, bad), failures, 4)
    assert not scan.RateLimit(0, 7).run((), np.zeros(3), np.arange(3.0))[0]["allowed"].any()


@pytest.mark.parametrize("part", [37, scan.PART])
def test_folds_equal_row_by_row(spark, part):
    rng = random.Random(6)
    rows, clock = [], {}
    for i in range(1500):
        s = rng.choice(["hot"] * 6 + ["a", "b", "c", None])
        clock[s] = clock.get(s, 0) + rng.choice([0, 1, 1, 2, 6, 30])
        rows.append((s, i, clock[s], rng.choice("AAAAAAAB"), rng.choice([True] * 14 + [False, None])))
    df = spark.createDataFrame(rows, "s string, i long, t long, c string, ok boolean").withColumn("t", F.timestamp_seconds("t")).repartition(5)
    out = {r.i: r for r in O.confirm_repeats(df, "s", "t", "c", "ok", "i", 3, 5, part).collect()}
    allowed = {r.i: r.allowed for r in O.rate_limited(df, "s", "t", "i", 3, 7, part).collect()}
    locks = {r.s: (r.n_lockouts, r.n_refused) for r in O.lockouts(df.withColumn("ok", ~F.col("ok") | (F.col("i") % 3 > 0)), "s", "t", "i", "ok", 3, 1, part).collect()}
    assert len(out) == len(allowed) == len(rows) and None not in locks
    for s in ("hot", "a", "b", "c", None):
        own = sorted(((t, i, c, bool(ok), ok) for k, i, t, c, ok in rows if k == s))
        want = streaks([(c, ok, t) for t, _, c, ok, _ in own], 3, 5)
        assert [(out[i].consecutive, out[i].confirmed, out[i].newly_confirmed) for _, i, *_ in own] == want
        assert [allowed[i] for _, i, *_ in own] == limited([t for t, *_ in own], 3, 7)
        if s:
            bad = [(t, bool((ok is False) or (i % 3 > 0)) if ok is not None or i % 3 > 0 else False) for t, i, _, _, ok in own]
            assert locks[s] == locked(bad, 3, 60)
    assert O.confirm_repeats(df.limit(0), "s", "t", "c", "ok", "i", 3, 5).count() == 0


def test_one_session_spreads_over_tasks(spark):
    n = 400_000
    df = spark.range(n).select(F.lit("one").alias("s"), F.col("id").alias("i"), F.timestamp_seconds(F.col("id")).alias("t"), F.lit("A").alias("c"), F.lit(True).alias("ok"))
    out = O.confirm_repeats(df, "s", "t", "c", "ok", "i", 3, 5, part_rows=50_000)
    assert out.groupBy(F.spark_partition_id()).count().count() > 1
    r = out.agg(F.count("*").alias("n"), F.count_if("newly_confirmed").alias("new"), F.max("consecutive").alias("most"), F.count_if("confirmed").alias("yes")).first()
    assert (r.n, r.new, r.most, r.yes) == (n, 1, n - 3, n - 2)


def test_lifecycle(spark):
    rows = [(1, 0, "acknowledge"), (1, 1, "escalate"), (2, 0, "resolve"), (2, 1, "acknowledge"), (2, 2, "nonsense"), (3, 0, "nonsense"), (4, 0, "nonsense"), (4, 1, "dismiss"), (5, 0, "acknowledge"), (5, 1, None)]
    df = spark.createDataFrame([(a, i, i, x) for a, i, x in rows], "alert long, at long, tie long, action string")
    got = {r.alert: (r.status, r.n_refused) for r in O.replay_lifecycle(df, "alert", "at", "tie", "action").collect()}
    assert got == {1: ("Escalated", 0), 2: ("Resolved", 2), 3: ("New", 0), 4: ("Dismissed", 0), 5: ("Acknowledged", 0)}


@pytest.mark.parametrize("seconds", [0, 5, 60])
def test_trailing_counts_equal_brute_force(spark, seconds):
    rng = random.Random(seconds)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *[rng.uniform(-150, 150) for _ in range(9)]])) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, c string, t double").withColumn("t", F.col("t").cast("timestamp"))
    floor = lambda t: None if t is None else math.floor(t)
    inside = lambda s, t: s == t if s is None or t is None else t - seconds <= s <= t
    want = {i: sum(d == c and inside(floor(s), floor(t)) for _, d, s in rows) for i, c, t in rows}
    assert {r.i: r.repeats for r in O.repeats_within(df, ["c"], "t", seconds).collect()} == want


def test_no_frame_slides_over_rows(spark):
    df = spark.createDataFrame([(1, "a", 5)], "i long, c string, t long").withColumn("t", F.timestamp_seconds("t"))
    out = O.capped(df, "c", "t", 21_600)
    plan = out._jdf.queryExecution().optimizedPlan().toString()  # a sliding frame adds up all its rows again for each row
    assert out.columns == ["i", "c", "t", "within_cap"] and "-21600" not in plan
