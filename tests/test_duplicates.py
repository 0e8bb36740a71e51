"""Two-stage audio duplicates against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from echotable.functions import audio as A
from echotable.operators import audio as W
from echotable.operators import duplicates as U


def brute(prints, least, shortlist):
    want = {}
    known = {(i, p) for i, p in prints if i is not None and p}
    for i, p in known:
        near = sorted((-A.equal_bits(p, q), j) for j, q in known if j < i and len(p) == len(q))
        want[i] = [(j, -s) for s, j in near if -s >= least - 1e-12][:shortlist]
    return {(i, j): (place, s) for i, rows in want.items() for place, (j, s) in enumerate(rows, 1)}


@pytest.mark.parametrize("crowded,block,least", [(256, 512, 0.92), (4, 8, 0.92), (2, 16, 0.97), (1, 512, 1.0)])
def test_near_prints_equal_brute_force(spark, crowded, block, least):
    rng = random.Random(3)
    base = [rng.randbytes(64) for _ in range(6)]
    half = base[0][:32]
    base += [half + rng.randbytes(32) for _ in range(3)]  # alike in half of their bits, and no more
    prints = []
    for i in range(160):
        p = np.unpackbits(np.frombuffer(rng.choice(base), np.uint8))
        p[rng.sample(range(512), rng.choice([0, 1, 3, 10, 21, 40]))] ^= 1
        prints.append((i, np.packbits(p).tobytes()))
    prints += [(160 + i, prints[5][1]) for i in range(12)] + [(2, prints[2][1]), (None, base[0]), (900, None), (901, b""), (902, b"short print"), (903, b"short print")]
    df = spark.createDataFrame([(i, p) for i, p in prints], "clip_id long, print binary").repartition(3)
    got = U.near_prints(df, "clip_id", "print", least, 4, crowded, block).collect()
    assert {(r.clip_id, r.near_key): (r.place, pytest.approx(r.similarity)) for r in got} == brute(prints, least, 4)
    assert U.near_prints(df.limit(0), "clip_id", "print", least).count() == 0


def test_low_similarities_are_refused(spark):
    with pytest.raises(ValueError):
        U.allowed_bits(512, 0.8)
    assert U.allowed_bits(512, 0.92) == 40


def test_copies_are_confirmed_and_their_clips_fetched(spark):
    rng = np.random.default_rng(8)
    steps = rng.normal(size=(6, 64)) / 8
    sound = [A.rustle(s, 16_000) for s in steps]
    clips = [(i, x.tolist(), 16_000) for i, x in enumerate(sound)]
    clips += [(10, (sound[2][80:] * 0.5).tolist(), 16_000), (11, sound[3].tolist(), 16_000), (12, None, 16_000), (13, sound[0][:1000].tolist(), 16_000)]
    df = spark.createDataFrame(clips, "clip_id long, samples array<float>, rate long")
    short = U.near_prints(W.fingerprints(df), "clip_id", "fingerprint", 0.9)
    got = {(r.clip_id, r.near_key): r for r in U.confirmed_duplicates(df, short, "clip_id").collect()}
    assert (10, 2) in got and got[10, 2].confirmed and got[10, 2].best and got[11, 3].match == pytest.approx(1.0, abs=1e-6)
    for (a, b), r in got.items():
        data = dict((i, x) for i, x, _ in clips)
        assert r.match == pytest.approx(A.aligned_correlation(np.array(data[a], np.float32), np.array(data[b], np.float32), 16_000), abs=1e-6)
        assert r.confirmed == (r.match >= 0.9)
    assert sum(r.best for r in got.values()) == len({a for (a, b), r in got.items() if r.confirmed})


def test_loaded_clips_match_as_those_that_hold_samples(spark):
    rng = np.random.default_rng(9)
    rows = [(2 * i + k, v, 1.0 - 0.5 * k, 80 * k) for i, v in enumerate((rng.normal(size=(4, 64)) / 8).tolist()) for k in (0, 1)]
    sources = spark.createDataFrame(rows, "clip_id long, numbers array<double>, gain double, skip int")
    load = lambda x: W.sounds(x, "numbers", "gain", "skip")
    short = U.near_prints(W.fingerprints(load(sources)).select("clip_id", "fingerprint"), "clip_id", "fingerprint", 0.9)
    got = U.confirmed_duplicates(sources, short, "clip_id", load=load)
    want = U.confirmed_duplicates(load(sources), short, "clip_id")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.where("best").count() == 4


def test_waveforms_are_handed_on_a_few_at_a_time(spark):
    sources = spark.range(0, 300, 1, 1).selectExpr("id", "array(0.1d, 0.2d, 0.3d, 0.4d) as numbers", "1.0d as gain", "0 as skip")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "mb": [b.nbytes / 1e6]})

    clips = W.encode_wav(W.sounds(sources, "numbers", "gain", "skip"))
    made = clips.select("samples", "content").mapInArrow(sizes, "rows long, mb double").collect()
    assert sum(r.rows for r in made) == 300 and max(r.mb for r in made) < 10
