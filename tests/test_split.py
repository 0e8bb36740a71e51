"""The exact-quota split: the stated rule group by group, every possible fit, lineage and its faults."""

from __future__ import annotations

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotable.functions.config import CLASSES
from echotable.operators import dataset as M
from echotable.operators import split as P


def plain(sizes, counts, target, room):
    """The rule, one group after the other: partitions by size, or None where a group fits nowhere."""
    room, out = list(room), []
    for size, count in zip(sizes, counts):
        own = []
        for _ in range(count):
            fits = [s for s in range(3) if room[s] >= size and target[s] > 0]
            if not fits:
                return None
            s = max(fits, key=lambda s: (room[s] / target[s], -s))
            room[s] -= size
            own.append(s)
        out.append(own)
    return out


def listed(dealt, counts):
    out = []
    for d, count in zip(dealt, counts):
        own = list(d.get("listed", []))
        for n, turns in d.get("turns", []):
            own += turns.at(np.arange(n)).tolist()
        assert len(own) == count
        out.append(own)
    return out


def cases(n):
    rng = random.Random(4)
    for _ in range(n):
        sizes = sorted(rng.sample(range(1, 9), rng.randint(1, 4)), reverse=True)
        counts = [rng.randint(1, 12) for _ in sizes]
        total = sum(s * c for s, c in zip(sizes, counts))
        a = rng.randint(0, total)
        b = rng.randint(0, total - a)
        yield sizes, counts, rng.choice([[round(total * 0.7), round(total * 0.15), total - round(total * 0.7) - round(total * 0.15)], [a, b, total - a - b]])


def test_dealing_equals_the_rule_or_finds_a_fit():
    rescued = refused = 0
    for sizes, counts, room in cases(400):
        want = plain(sizes, counts, room, room)
        try:
            got = listed(P.deal(sizes, counts, room, room), counts)
        except ValueError:
            assert want is None
            refused += 1
            # no fit at all: fills of two partitions by brute force, the third gets the rest
            made = {(0, 0)}
            for size, count in zip(sizes, counts):
                made = {(x + i * size, y + j * size) for x, y in made for i, j in product(range(count + 1), repeat=2) if i + j <= count and x + i * size <= room[1] and y + j * size <= room[2]}
            assert (room[1], room[2]) not in made
            continue
        if want is not None:
            assert got == want
        else:
            rescued += 1
        for s in range(3):
            assert sum(size * own.count(s) for size, own in zip(sizes, got)) == room[s]
    assert rescued > 5 and refused > 5


def test_fit_that_proportional_dealing_misses():
    got = listed(P.deal([3, 2], [1, 2], [4, 3, 0], [4, 3, 0]), [1, 2])
    assert got == [[1], [0, 0]]
    with pytest.raises(ValueError):
        P.deal([9], [1], [5, 5, 5], [5, 5, 5])
    assert listed(P.deal([9], [1], [5, 6, 5], [5, 6, 5], "largest_room"), [1]) == [[1]]


def test_large_histograms_are_dealt_without_a_loop_over_groups():
    sizes, counts = [7, 3, 1], [1_000_000, 3_000_000, 50_000_000]
    total = sum(s * c for s, c in zip(sizes, counts))
    room = [total * 7 // 10, total * 15 // 100, total - total * 7 // 10 - total * 15 // 100]
    left = list(room)
    for size, d in zip(sizes, P.deal(sizes, counts, room, room)):
        left = [r - size * sum(t.total(n)[s] for n, t in d["turns"]) for s, r in enumerate(left)]
    assert left == [0, 0, 0]


def test_cells_over_the_limit_are_cut_down(monkeypatch):
    monkeypatch.setattr(P, "CELLS", 40)
    room = [14, 6, 6]
    got = listed(P.deal([4, 2, 1], [4, 3, 4], room, room), [4, 3, 4])
    assert [sum(size * own.count(s) for size, own in zip([4, 2, 1], got)) for s in range(3)] == room


def manifest(spark, n=3000):
    rows = [(f"C{i:05d}", CLASSES[i % 10], f"g{i % 10}-{i // 10 // 3}", "original", None) for i in range(n)]
    rows += [(f"X{i:05d}", CLASSES[i % 10], None, "augmented", f"C{i:05d}") for i in range(50)]
    return spark.createDataFrame(rows, "audio_id string, class_label string, source_group string, role string, parent_audio_id string")


def test_split_invariants(spark):
    m = manifest(spark)
    out = P.split(m)
    got = {(r.class_label, r.split): r["count"] for r in out.where("role = 'original'").groupBy("class_label", "split").count().collect()}
    assert all(got[c, "train"] == 210 and got[c, "val"] == 45 and got[c, "test"] == 45 for c in CLASSES)
    assert M.leaks(out).count() == 0 and out.count() == 3050 and M.coverage(m, out).count() == 0
    assert M.differences(out.select("audio_id", "split"), P.split(m.orderBy(F.desc("audio_id"))).select("audio_id", "split")).count() == 0
    assert M.differences(out.select("audio_id", "split"), P.split(m, seed=7).select("audio_id", "split")).count() > 0
    assert P.split_counts(out, 0).where("not ok").count() == 0


def test_mixed_groups_lone_clips_and_faults(spark):
    rows = [("m1", "a", "mix", "original", None), ("m2", "b", "mix", "original", None)]
    rows += [(f"a{i}", "a", None, "original", None) for i in range(19)] + [(f"b{i}", "b", f"g{i}", "original", None) for i in range(9)] + [("k", "a", None, "augmented", "m1")]
    schema = "audio_id string, class_label string, source_group string, role string, parent_audio_id string"
    out = {r.audio_id: (r.group, r.split) for r in P.split(spark.createDataFrame(rows, schema)).collect()}
    assert len(out) == 31 and out["m1"] == out["m2"] == out["k"] == ("mix", "train") and out["a3"][0] == "clip:a3"
    assert sum(s == "train" for k, (_, s) in out.items() if k[0] in "am") == 14 + 1
    for bad, what in ((("z", "a", None, "augmented", "nobody"), "z has no parent"), (("z", "b", None, "augmented", "a1"), "z has another label"), (("z", "a", None, "augmented", None), "z has no parent")):
        with pytest.raises(Exception, match=what):
            P.split(spark.createDataFrame([*rows, bad], schema)).collect()
