"""Hand-computed cases of the sound-event operators."""

from __future__ import annotations

import io
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotable.functions import audio as A
from echotable.functions import scores as S
from echotable.functions.config import CLASSES, THRESHOLDS, effective_rules, resolve
from echotable.operators import audio as W
from echotable.operators import compare as C
from echotable.operators import dataset as M
from echotable.operators import duplicates as U
from echotable.operators import ordered as O
from echotable.operators import serving as V
from echotable.sources import files

PINNED = {**THRESHOLDS, "confidence": {**THRESHOLDS["confidence"], "min_confidence": 0.6}, "consistency": {**THRESHOLDS["consistency"], "confident_agreement_min": 0.8}}


def test_five_statuses(spark):
    rows = [("A", 0.92, "A", 0.90), ("A", 0.90, "A", 0.80), ("A", 0.95, "A", 0.72), ("A", 0.95, "B", 0.94), ("A", 0.10, "A", 0.12), ("A", 0.5, "A", 0.9), ("A", 0.9, "A", 0.5)]
    df = spark.createDataFrame(rows, "a string, x double, b string, y double").select(S.consistency_status(*[F.col(c) for c in "axby"], PINNED).alias("s"))
    assert [r.s for r in df.collect()] == ["Strong Match", "Acceptable Match", "Weak Match", "Model Disagreement", "Uncertain Result", "Uncertain Result", "Weak Match"]


def test_normalise_and_predict(spark):
    df = spark.createDataFrame([([1.0, float("nan"), -2.0, 3.0],), ([0.0, 0.0, 0.0, 0.0],)], "v array<double>")
    got = [r.n for r in df.select(S.normalise(F.col("v")).alias("n")).collect()]
    assert got == [[0.25, 0.0, 0.0, 0.75], [0.25] * 4]
    top = df.select(S.predicted(S.named(S.normalise(F.col("v")), "abcd")).alias("p")).collect()
    assert [r.p.class_name for r in top] == ["d", "d"]  # of equals the largest name


def test_references_and_unknown_conditions():
    assert resolve("$thresholds.confidence.min_confidence") == 0.4 and len(effective_rules()) == 10
    with pytest.raises(ValueError):
        S.predicate({"surprise": 1}, {})


def test_confusion_hand_case(spark):
    rows = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "A")], "actual string, predicted string")
    m = C.confusion(rows, ("A", "B", "C"))
    assert {(r.actual, r.predicted): r.n for r in m.collect() if r.n} == {("A", "A"): 1, ("A", "B"): 1, ("B", "A"): 1} and m.count() == 9
    c = {r.class_name: r for r in C.per_class(m).collect()}
    assert (c["A"].precision, c["A"].recall, c["C"].f1, c["C"].support) == (0.5, 0.5, 0.0, 0)
    s = C.summary(C.per_class(m), critical=("A",)).first()
    assert s.accuracy == pytest.approx(1 / 3) and s.macro_f1 == pytest.approx(0.5 / 3) and s.critical_recall == 0.5
    with pytest.raises(Exception, match="unknown label"):
        C.confusion(rows, ("A",)).collect()


def test_severe_errors_and_floors(spark):
    rows = spark.createDataFrame([("Gunshot", "Aggression"), ("Gunshot", "Background Noise"), ("Panic Scream", "Vehicle Horn"), ("Gunshot", "Gunshot")], "actual string, predicted string")
    got = {(r.actual, r.predicted): (r.silent_miss, r.misattributed) for r in C.severe_errors(rows).collect()}
    assert got == {("Gunshot", "Aggression"): (False, True), ("Gunshot", "Background Noise"): (True, False), ("Panic Scream", "Vehicle Horn"): (True, False)}
    m = spark.createDataFrame([(0.85 - 1e-13, 0.7)], "accuracy double, macro_f1 double")
    assert {r.metric: r.passed for r in C.check_floors(m, {"accuracy": 0.85, "macro_f1": 0.8}).collect()} == {"accuracy": True, "macro_f1": False}


def test_gates_and_reviews(spark):
    rows = [("Gunshot", 0.61, 0.05, "Poor", False, "Model Disagreement"), ("Gunshot", 0.95, 0.60, "Good", True, "Strong Match"), ("Background Noise", 0.9, 0.5, "Good", True, "Strong Match")]
    e = spark.createDataFrame([(*r, r[1], False, 0.0) for r in rows], "python_class string, python_confidence double, margin double, quality string, agree boolean, status string, gtm_confidence double, overlapping boolean, difference double")
    got = [r.alert_eligible for r in C.apply_rules(e, C.rules_frame(spark)).collect()]
    assert got == [False, True, False]
    ids = [r.review_ids for r in C.review(e).collect()]
    assert ids[0] == "model_disagreement,poor_audio_quality,similar_top_classes,critical_without_agreement,possible_false_alarm" and ids[1:] == ["", ""]
    with pytest.raises(Exception, match="no rule for class"):
        C.apply_rules(e.withColumn("python_class", F.lit("Thunder")), C.rules_frame(spark)).collect()


def test_alignment_faults(spark):
    a, b = spark.range(3).select("id", F.lit(1).alias("x")), spark.range(3).select("id", F.lit(2).alias("y"))
    assert C.align(a, b, "id").count() == 3
    with pytest.raises(Exception, match="unaligned key"):
        C.align(a, b.where("id < 2"), "id").collect()


def test_streaks(spark):
    def run(rows, **how):
        df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "s long, i long, c string, ok boolean, t long").withColumn("t", F.timestamp_seconds("t"))
        return [(r.consecutive, r.confirmed, r.newly_confirmed) for r in O.confirm_repeats(df, "s", "t", "c", "ok", "i", 3, 8, **how).orderBy("i").collect()]

    same = [("A", True, 2 * k) for k in range(5)]
    assert run(same) == [(1, False, False), (2, False, False), (3, True, True), (1, True, False), (2, True, False)]
    assert run([("A", False, k) for k in range(4)])[-1] == (0, False, False)
    assert run([("A", True, 0), ("A", True, 2), ("B", True, 4), ("A", True, 6)])[-1] == (1, False, False)
    assert run([("A", True, 9 * k) for k in range(4)])[-1] == (1, False, False)


def test_outages(spark):
    def run(marks):
        df = spark.createDataFrame([("b", i, m == "u") for i, m in enumerate(marks)], "base string, t long, up boolean").withColumn("t", F.timestamp_seconds("t"))
        return sorted((int(r.started_at.timestamp()), int(r.ended_at.timestamp()), r.length) for r in O.outages(df, "base", "t", "up").collect())

    assert run("uuddduudu") == [(2, 4, 3), (7, 7, 1)] and run("uudd") == [(2, 3, 2)]


def test_rate_limit_and_lockout(spark):
    t = spark.createDataFrame([(1, i, s, i < 5) for i, s in enumerate([0, 1, 2, 3, 11, 12, 13])], "u long, i long, t long, bad boolean").withColumn("t", F.timestamp_seconds("t"))
    assert [r.allowed for r in O.rate_limited(t, "u", "t", "i", 2, 10).orderBy("i").collect()] == [True, True, False, False, True, True, False]
    r = O.lockouts(t, "u", "t", "i", "bad", 5, 15).first()
    assert (r.n_lockouts, r.n_refused) == (1, 2)


def test_manifest_faults(spark):
    rows = [("a", "x", "original", None, "CC0"), ("a", "x", "original", None, "CC0"), ("b", "z", "augmented", None, ""), ("c", "x", "augmented", "nobody", "CC0")]
    m = spark.createDataFrame(rows, "audio_id string, class_label string, role string, parent_audio_id string, licence string")
    got = sorted((r.audio_id, r.violation) for r in M.violations(m, ["x"]).collect())
    assert got == [("a", "duplicate_id"), ("a", "duplicate_id"), ("b", "augmented_without_parent"), ("b", "blank_licence"), ("b", "unknown_class")]
    assert [(r.audio_id, r.fault) for r in M.lineage_faults(m).collect()] == [("c", "missing_parent")]


def test_retention_holds(spark):
    ts = F.lit("2020-01-01").cast("timestamp")
    f = spark.createDataFrame([(1, False), (2, True), (3, False), (4, False)], "audio_key long, flagged boolean").withColumn("created_at", ts)
    e = spark.createDataFrame([(10, 1, "Low"), (20, 2, "Low"), (30, 3, "Low"), (40, 4, "Low")], "event_id long, audio_key long, severity string")
    al = spark.createDataFrame([(30, "Acknowledged"), (10, "Resolved")], "event_id long, status string")
    rv = spark.createDataFrame([(40, "Pending Review")], "event_id long, status string")
    plan = V.retention_plan(f, e, al, rv, F.lit("2024-01-01").cast("timestamp")).collect()
    assert [(r.audio_key, r.keep_days) for r in plan] == [(1, 180)]


def test_search_arguments_and_cells(spark):
    assert V.canonical("GUNSHOT, thunder", CLASSES) == (["Gunshot"], ["thunder"])
    cells = spark.createDataFrame([("=1+1",), (" @x",), ("ok",), (None,)], "c string").select(S.csv_safe(F.col("c")).alias("c"))
    assert [r.c for r in cells.collect()] == ["'=1+1", "' @x", "ok", None]


def test_exact_duplicates(spark):
    batch = spark.createDataFrame([("b1", "h1"), ("b2", "h1"), ("b3", "h2")], "audio_id string, sha string")
    store = spark.createDataFrame([("s1", "h2")], "audio_id string, sha string")
    got = {r.audio_id: r.duplicate_of for r in U.exact_matches(batch, store, "sha", "audio_id").collect()}
    assert got == {"b1": None, "b2": "b1", "b3": "s1"}


def wav(x, rate=16_000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_tone_levels_and_verdicts(spark):
    t = np.arange(32_000) / 16_000
    tone, pulse = 0.5 * np.sin(2 * np.pi * 440 * t), 0.8 * np.sin(2 * np.pi * 440 * t) * (t % 1 < 0.5)
    m = A.measure(tone.astype(np.float32), 16_000)
    assert m["peak_dbfs"] == pytest.approx(-6.0206, abs=0.01) and m["rms_dbfs"] == pytest.approx(-9.0309, abs=0.01)
    df = spark.createDataFrame([("tone", wav(tone)), ("silence", wav(0 * t)), ("short", wav(tone[:100])), ("pulse", wav(pulse)), ("bad", b"xx")], "path string, content binary")
    d = W.decode_wav(df)
    got = {r.path: r for r in W.measure(d.where("error is null")).collect()}
    assert got["silence"].verdict == "Unusable" and got["short"].problems.startswith("unsuitable_duration") and got["pulse"].verdict == "Good"
    assert d.where("error is not null").count() == 1
    p = A.fingerprint(pulse.astype(np.float32), 16_000)
    assert A.equal_bits(p, A.fingerprint((0.3 * pulse).astype(np.float32), 16_000)) > 0.95
    assert A.aligned_correlation(pulse, pulse[3200:28_800], 16_000) > 0.9
    assert (A.augment(tone, 16_000, "noise", 3) == A.augment(tone, 16_000, "noise", 3)).all()
    assert A.resample(tone.astype(np.float32), 16_000, 8_000).shape == (16_000,)
    laid = A.augment(tone, 16_000, "overlay", 3, pulse[:900])
    assert len(laid) == len(tone) and np.abs(laid - tone).max() > 0.01 and np.abs(laid).max() <= 1
    with pytest.raises(ValueError):
        A.augment(tone, 16_000, "overlay", 3)


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "a.wav", "x", "CC0", "h", "=cmd"), ("b", "b.wav", "x", "", "h", None)], "audio_id string, filename string, class_label string, licence string, sha256 string, note string")
    files.export_csv(rows, f"{tmp_path}/m", rows.columns)
    back = {r.audio_id: r for r in files.load_manifest(spark, f"{tmp_path}/m").collect()}
    assert back["a"].note == "'=cmd" and back["b"].licence is None
    with pytest.raises(ValueError):
        files.export_csv(rows, f"{tmp_path}/n", rows.columns, limit=1)
    with pytest.raises(ValueError):
        files.load_manifest(spark, f"{tmp_path}/m", required=("nothing",))


def test_near_matches_equal_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = []
    for i in range(150):
        p = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, 6)):
            p ^= 1 << b
        prints.append((i, p - (1 << 64) if p >> 63 else p))
    prints += [(150 + i, prints[3][1]) for i in range(20)] + [(None, 1), (999, None)]
    df = spark.createDataFrame(prints, "clip_id long, print long").repartition(3)
    got = {(r.clip_id, r.near_key): (r.place, r.similarity) for r in U.near_matches(df, "clip_id", "print", 0.92, 4).collect()}
    want = {}
    known = [(i, p) for i, p in prints if i is not None and p is not None]
    for i, p in known:
        near = sorted((-(1 - bin((p ^ q) & (1 << 64) - 1).count("1") / 64), j) for j, q in known if j < i)
        for place, (s, j) in enumerate([x for x in near if -x[0] >= 0.92][:4], 1):
            want[i, j] = (place, -s)
    assert got == want
    with pytest.raises(ValueError):
        U.near_matches(df, "clip_id", "print", 0.6, 4)


def test_covering_segments(spark):
    cases = {0: [], 50: [(0, 50)], 100: [(0, 100)], 250: [(0, 100), (75, 175), (150, 250)], 101: [(0, 100), (1, 101)]}
    df = spark.createDataFrame([(n,) for n in cases], "n long").withColumn("b", M.covering_bounds(F.col("n"), F.lit(100).cast("long")))
    assert {r.n: [tuple(x) for x in r.b] for r in df.collect()} == cases


def test_blank_split_is_an_error(spark):
    rows = spark.createDataFrame([("a", "original", "test"), ("b", "augmented", "test"), ("c", "original", "train")], "audio_id string, role string, dataset_split string")
    assert [r.audio_id for r in M.select_split(rows, "test").collect()] == ["a"]
    with pytest.raises(Exception, match="no split for d"):
        M.select_split(rows.unionByName(spark.createDataFrame([("d", "original", " ")], rows.schema)), "test").collect()


def test_spike_needs_more_than_the_least_usual_level(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    rows = [(f"2024-01-01 23:{m:02d}:00", 0.1 if m % 2 else 0.9, "Low") for m in range(10, 30)] + [("2024-01-01 10:00:00", 0.9, "Low")]
    events = spark.createDataFrame(rows, "created_at string, python_confidence double, severity string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    none = lambda schema: spark.createDataFrame([], schema)
    alerts, reviews = none("created_at timestamp, severity string"), none("status string")
    audit = spark.createDataFrame([("2024-01-01 23:59:00", "model_failure", "failure")], "at string, action string, outcome string")
    users = spark.createDataFrame([("2024-01-03 00:00:00",)], "locked_until string")
    fired = {r.check: r.observed for r in V.anomalies(events, alerts, reviews, audit, users, now).collect()}
    assert fired == {"model_failures": 1.0, "low_confidence_spike": 0.5, "failed_logins": 0.0, "error_rate": 1.0}
