"""Clips as rows: vectorised helpers over waveforms, everything after the measurement built in."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotable.functions import audio as A
from echotable.functions.config import THRESHOLDS
from echotable.operators.dataset import covering_bounds
from echotable.sources.scratch import bounded_bytes

#: Rows of which waveforms are made at once.
TOGETHER = 64
_MEASURES = ("duration_sec", "peak_dbfs", "rms_dbfs", "loudest_dbfs", "clipping_ratio", "snr_db")


def decode_wav(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``(path, rate, channels, bits, duration_sec, samples, error)`` of WAV bytes; unreadable ones carry an error."""
    bounded_bytes(files.sparkSession)

    def run(pdfs):
        for pdf in pdfs:
            for at in range(0, len(pdf), TOGETHER):
                rows = []
                for p, data in zip(pdf[path].iloc[at : at + TOGETHER], pdf[content].iloc[at : at + TOGETHER]):
                    try:
                        rate, channels, bits, sec, x = A.read_wav(bytes(data))
                        rows.append((p, rate, channels, bits, sec, x, None))
                    except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed job
                        rows.append((p, None, None, None, None, None, str(e) or type(e).__name__))
                yield pd.DataFrame(rows, columns=["path", "rate", "channels", "bits", "duration_sec", "samples", "error"])

    return files.select(path, content).mapInPandas(run, "path string, rate long, channels long, bits long, duration_sec double, samples array<float>, error string")


def encode_wav(clips: DataFrame, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """``clips`` with ``content``: their samples as 16-bit WAV bytes; null samples give null."""
    bounded_bytes(clips.sparkSession)

    @F.pandas_udf("binary")
    def run(x: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else A.write_wav(np.asarray(v, np.float64), int(k)) for v, k in zip(x, r)], dtype=object)

    return clips.withColumn("content", run(samples, rate))


def measure(clips: DataFrame, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """``clips`` with measurements and verdict; null samples are an empty clip."""

    @F.pandas_udf(", ".join([*(f"{m} double" for m in _MEASURES), "longest_clip_run long", "missing_samples long"]))
    def values(x: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([A.measure(np.asarray(v if v is not None else [], np.float32), int(k or 0)) for v, k in zip(x, r)])

    out = clips.withColumn("_m", values(samples, rate))
    out = out.select(*[c for c in clips.columns if c not in (*_MEASURES, "longest_clip_run", "missing_samples")], "_m.*")
    return out.withColumn("problems", F.array_join(problems(), ",")).withColumn("verdict", verdict())


def problems(limits=THRESHOLDS["audio_quality"]) -> Column:
    """Names of the problems that the measurements show."""
    silent = F.col("loudest_dbfs") <= limits["silence_rms_dbfs_max"]
    return F.array_compact(F.array(
        F.when(silent, "silence"), F.when(F.col("missing_samples") > 0, "missing_frames"),
        F.when((F.col("duration_sec") < limits["min_duration_sec"]) | (F.col("duration_sec") > limits["max_duration_sec"]), "unsuitable_duration"),
        F.when(F.col("clipping_ratio") > limits["clipping_ratio_max"], "clipping"), F.when(F.col("snr_db") < limits["poor_snr_db"], "excessive_noise"),
        F.when(~silent & (F.col("peak_dbfs") < -40), "low_signal"),
    ))


def verdict(limits=THRESHOLDS["audio_quality"]) -> Column:
    """Good, Acceptable, Poor or Unusable; silence or too short a clip is unusable."""
    shortest, clip = limits["min_duration_sec"], limits["clipping_ratio_max"]
    silent = F.col("loudest_dbfs") <= limits["silence_rms_dbfs_max"]
    poor = (
        (F.col("clipping_ratio") > 5 * clip) | (F.col("snr_db") < limits["poor_snr_db"]) | (F.col("duration_sec") > limits["max_duration_sec"])
        | (F.col("peak_dbfs") < -40) | (F.col("missing_samples") > 0)
    )
    good = (F.col("snr_db") >= limits["good_snr_db"]) & (F.col("peak_dbfs") > -12) & (F.col("duration_sec") >= 1.0) & (F.col("clipping_ratio") <= clip)
    return F.when(silent | (F.col("duration_sec") < shortest), "Unusable").when(poor, "Poor").when(good, "Good").otherwise("Acceptable")


def _samples_udf(fn):
    @F.pandas_udf("array<float>")
    def run(x: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else fn(np.asarray(v, np.float32), int(k)) for v, k in zip(x, r)])

    return run


def condition(clips: DataFrame, samples: str = "samples", rate: str = "rate", to: int = 16_000) -> DataFrame:
    """``clips`` conditioned: filtered, gated, trimmed, normalised, at rate ``to``."""
    return clips.withColumn(samples, _samples_udf(lambda x, r: A.condition(x, r, to))(samples, rate)).withColumn(rate, F.lit(to).cast("long"))


def segment_features(clips: DataFrame, key: str, samples: str, rate: str, length_sec: float = 3.0) -> DataFrame:
    """``(key, segment, feature, value)`` of every segment; mean over segments by a group-by."""

    def run(pdfs):
        for pdf in pdfs:
            out = []
            for k, v, r in zip(pdf[key], pdf[samples], pdf[rate]):
                x, n = np.asarray(v if v is not None else [], np.float32), int(length_sec * r)
                for s in range(max(1, len(x) // n)):
                    out += [(k, s, f, value) for f, value in A.features(x[s * n : (s + 1) * n], int(r)).items()]
            yield pd.DataFrame(out, columns=["key", "segment", "feature", "value"])

    kind = clips.schema[key].dataType.simpleString()
    return clips.select(key, samples, rate).mapInPandas(run, f"key {kind}, segment long, feature string, value double").withColumnRenamed("key", key)


def fingerprints(clips: DataFrame, samples: str = "samples", rate: str = "rate") -> DataFrame:
    bounded_bytes(clips.sparkSession)

    @F.pandas_udf("binary")
    def run(x: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else A.fingerprint(np.asarray(v, np.float32), int(k)) for v, k in zip(x, r)], dtype=object)

    return clips.withColumn("fingerprint", run(samples, rate))


def sounds(rows: DataFrame, numbers: str, gain: str, skip: str, rate: int = 16_000) -> DataFrame:
    """``rows`` with ``samples`` and ``rate``: noise in the bands that each array of numbers states, scaled by ``gain`` and without the first ``skip`` samples.

    A few numbers make a whole recording, so recordings are handed on a few at a time.
    """
    bounded_bytes(rows.sparkSession)
    names = [c for c in rows.columns if c not in ("samples", "rate")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                x, g, k = (part.column(names.index(c)).to_pylist() for c in (numbers, gain, skip))
                made = [(A.rustle(v, rate)[int(n) :] * y).round(3) for v, y, n in zip(x, g, k)]
                ends = np.cumsum([0, *(len(v) for v in made)], dtype=np.int32)
                held = pa.ListArray.from_arrays(ends, np.concatenate(made))
                yield pa.RecordBatch.from_arrays([*part.columns, held, pa.array([rate] * len(made), pa.int64())], [*names, "samples", "rate"])

    typed = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return rows.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, f"{typed}, samples array<float>, rate long")


def images(clips: DataFrame, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """``clips`` with ``image``: the log-mel image of their samples as packed doubles, which is what correlations are taken of."""
    bounded_bytes(clips.sparkSession)

    @F.pandas_udf("binary")
    def run(x: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else A.log_mel(np.asarray(v, np.float32), int(k)).tobytes() for v, k in zip(x, r)], dtype=object)

    return clips.withColumn("image", run(samples, rate))


def confirm_pairs(pairs: DataFrame, a: str, b: str, least: float = THRESHOLDS["duplicate_detection"]["spectral_match_min"]) -> DataFrame:
    """Shortlisted pairs with ``match``, the correlation of their two images; those of at least ``least`` are confirmed."""
    bounded_bytes(pairs.sparkSession)

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([A.best_correlation(A.unpacked(u), A.unpacked(v)) for u, v in zip(x, y)], dtype=float)

    return pairs.withColumn("match", run(a, b)).withColumn("confirmed", F.col("match") >= least)


def augmented(plan: DataFrame, samples: str = "samples", rate: str = "rate", under: str | None = None) -> DataFrame:
    """Rows of an augmentation plan (recipe, seed) with the recipe applied to their samples; ``under`` names the samples that an overlay lays below them."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series, r: pd.Series, recipe: pd.Series, seed: pd.Series, other: pd.Series) -> pd.Series:
        clip = lambda v: None if v is None else np.asarray(v, np.float32)
        return pd.Series([A.augment(clip(v), int(k), n, int(s), clip(o)) for v, k, n, s, o in zip(x, r, recipe, seed, other)])

    other = F.col(under) if under else F.lit(None).cast("array<float>")
    return plan.withColumn(samples, run(samples, rate, "recipe", "seed", other))


def loudest_windows(clips: DataFrame, samples: str, size: int, count: int) -> DataFrame:
    @F.pandas_udf("array<long>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([A.loudest_windows(np.asarray(v, np.float32), size, count) for v in x])

    return clips.withColumn("window_starts", run(samples))


def envelope(clips: DataFrame, key: str, samples: str, columns: int) -> DataFrame:
    """``(key, column, low, high)``: the waveform's envelope in a number of columns. Built in."""
    rows = clips.select(key, F.size(samples).alias("n"), F.posexplode(samples).alias("at", "x"))
    column = F.floor(F.col("at") * columns / F.col("n")).cast("int")
    return rows.groupBy(key, column.alias("column")).agg(F.min("x").alias("low"), F.max("x").alias("high"))


def band_statistics(frames: DataFrame, band: str, value: str) -> DataFrame:
    """``(band, mean, std)`` over training frames; a tiny deviation counts as 1."""
    g = frames.groupBy(band).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return g.withColumn("std", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")))


def standardise(frames: DataFrame, stats: DataFrame, band: str, value: str) -> DataFrame:
    return frames.join(F.broadcast(stats), band).withColumn(value, (F.col(value) - F.col("mean")) / F.col("std")).drop("mean", "std")


def segments(clips: DataFrame, key: str, samples: str, rate: str, length_sec: float = 3.0) -> DataFrame:
    """``(key, segment, start_sec, end_sec, samples)`` of evenly spread segments that cover each clip. Built in."""
    n = F.size(samples)
    length = F.round(F.col(rate) * length_sec).cast("long")
    rows = clips.select(key, samples, rate, F.posexplode(covering_bounds(n, length)).alias("segment", "b"))
    cut = F.slice(F.col(samples), (F.col("b.start") + 1).cast("int"), (F.col("b.end") - F.col("b.start")).cast("int"))
    sec = lambda at: F.round(F.col(at) / F.col(rate), 6)
    return rows.select(key, F.col("segment").cast("long").alias("segment"), sec("b.start").alias("start_sec"), sec("b.end").alias("end_sec"), cut.alias("samples"), rate)


def mel_images(clips: DataFrame, key: str, samples: str, rate: str, length_sec: float = 3.0, bands: int = 128, size: int = 2048, hop: int = 512, loudest_only: bool = False) -> DataFrame:
    """``(key, segment, n_frames, image)``: the log-mel image of each segment in dB, row by row; a short segment is centred in silence.

    With ``loudest_only`` the segment of most energy, the first of equals.
    """
    parts = segments(clips, key, samples, rate, length_sec)
    if loudest_only:
        power = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.greatest(F.size("samples"), F.lit(1))
        parts = parts.groupBy(key).agg(F.max_by(F.struct("segment", "samples", rate), F.struct(power, -F.col("segment"))).alias("x")).select(key, "x.*")

    @F.pandas_udf("n_frames long, image array<float>")
    def run(x: pd.Series, r: pd.Series) -> pd.DataFrame:
        images = [A.mel_decibels(np.asarray(v if v is not None else [], np.float32), int(k), int(round(length_sec * k)), bands, size, hop) for v, k in zip(x, r)]
        return pd.DataFrame({"n_frames": [m.shape[1] for m in images], "image": [m.ravel() for m in images]})

    return parts.select(key, "segment", run("samples", rate).alias("m")).select(key, "segment", "m.*")


def realism(clips: DataFrame, key: str, samples: str, rate: str) -> DataFrame:
    """``(key, crest_db, high_ratio, centroid_hz, modulation_hz, bands)`` of each clip, by which classes are compared."""

    @F.pandas_udf("crest_db double, high_ratio double, centroid_hz double, modulation_hz double, bands array<double>")
    def run(x: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([A.realism(np.asarray(v if v is not None else [], np.float64), int(k)) for v, k in zip(x, r)])

    return clips.select(*[c for c in clips.columns if c != samples], run(samples, rate).alias("m")).select(*[c for c in clips.columns if c != samples], "m.*")


def class_spectra(measured: DataFrame, label: str, bands: str = "bands") -> DataFrame:
    """``(a, b, cosine)``: how alike the mean band spectra of each two classes are."""
    mean = measured.select(label, F.posexplode(bands).alias("band", "x")).groupBy(label, "band").agg(F.avg("x").alias("x"))
    a, b = mean.select(F.col(label).alias("a"), "band", F.col("x").alias("x")), mean.select(F.col(label).alias("b"), "band", F.col("x").alias("y"))
    norm = F.sqrt(F.sum(F.col("x") ** 2) * F.sum(F.col("y") ** 2))
    return a.join(b, "band").where("a < b").groupBy("a", "b").agg((F.sum(F.col("x") * F.col("y")) / norm).alias("cosine"))
