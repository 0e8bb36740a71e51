"""Small NumPy helpers over one waveform; Spark spreads the clips."""

from __future__ import annotations

import io
import wave
import zlib

import numpy as np


def db(x: float) -> float:
    return 20.0 * float(np.log10(x)) if x > 0 else float("-inf")


def read_wav(data: bytes) -> tuple[int, int, int, float, np.ndarray]:
    """Rate, channels, bits, seconds, and mono float32 samples of PCM WAV bytes."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width, n = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
        raw = w.readframes(n)
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
    return rate, channels, 8 * width, n / rate if rate else 0.0, x.reshape(-1, channels).mean(1).astype(np.float32)


def write_wav(x: np.ndarray, rate: int) -> bytes:
    """Mono samples within full scale as 16-bit PCM WAV bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def frame_power(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Power spectra of Hann frames; a short clip is one padded frame."""
    x = np.pad(x, (0, max(0, size - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    return np.abs(np.fft.rfft(frames * np.hanning(size), axis=1)) ** 2


def snr(x: np.ndarray) -> float:
    """Loud against quiet frames, by their spectral power."""
    if len(x) < 64:
        return 0.0
    p = frame_power(x, 512 if len(x) >= 512 else 64, 256 if len(x) >= 512 else 32).sum(1)
    low, high = np.percentile(p, 10), np.percentile(p, 95)
    return float(10 * np.log10((high + 1e-12) / (low + 1e-12)))


def measure(x: np.ndarray, rate: int) -> dict:
    """Levels, clipping, noise, duration and missing samples of a clip."""
    missing = int((~np.isfinite(x)).sum())
    x = np.where(np.isfinite(x), x, 0.0).astype(np.float64)
    frame = max(1, int(0.05 * rate))
    whole = x[: len(x) // frame * frame].reshape(-1, frame)
    loud = float(np.sqrt((whole**2).mean(1).max())) if len(whole) else float(np.sqrt((x**2).mean())) if len(x) else 0.0
    full = np.concatenate([[0], (np.abs(x) >= 0.99).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(full))
    return {
        "duration_sec": len(x) / rate if rate else 0.0, "peak_dbfs": db(np.abs(x).max() if len(x) else 0.0), "rms_dbfs": db(float(np.sqrt((x**2).mean())) if len(x) else 0.0),
        "loudest_dbfs": db(loud), "clipping_ratio": float(full.sum() / max(1, len(x))), "longest_clip_run": int((edge[1::2] - edge[::2]).max()) if len(edge) else 0,
        "snr_db": snr(x), "missing_samples": missing,
    }


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Band-limited resampling in the frequency domain."""
    if rate == to or not len(x):
        return x
    n = max(1, round(len(x) * to / rate))
    spectrum = np.fft.rfft(x)
    out = np.zeros(n // 2 + 1, complex)
    k = min(len(spectrum), len(out))
    out[:k] = spectrum[:k]
    return (np.fft.irfft(out, n) * n / len(x)).astype(np.float32)


def condition(x: np.ndarray, rate: int, to: int = 16_000, high_pass: float = 60.0, drop_db: float = 40.0, peak: float = 0.95) -> np.ndarray:
    """High-pass, spectral gate, edge-silence trim, peak normalisation, resampling."""
    if not len(x):
        return x.astype(np.float32)
    f = np.fft.rfftfreq(len(x), 1 / rate)
    gain = 1 / np.sqrt(1 + (high_pass / np.maximum(f, 1e-9)) ** 8)
    spectrum = np.fft.rfft(x) * gain
    level = np.abs(spectrum)
    spectrum[level < np.percentile(level, 20)] *= 0.3
    y = np.fft.irfft(spectrum, len(x))
    frame = max(1, int(0.02 * rate))
    rms = np.sqrt(np.add.reduceat(y**2, np.arange(0, len(y), frame)) / frame)
    loud = np.flatnonzero(rms >= rms.max() * 10 ** (-drop_db / 20))
    if len(loud) and rms.max() > 0:
        y = y[loud[0] * frame : (loud[-1] + 1) * frame]
    top = np.abs(y).max()
    return resample((y * (peak / top) if top > 0 else y).astype(np.float32), rate, to)


def mel_filters(bands: int, size: int, rate: int) -> np.ndarray:
    """Triangular filters evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(size, 1 / rate)
    up = (f[None, :] - points[:-2, None]) / (points[1:-1] - points[:-2])[:, None]
    down = (points[2:, None] - f[None, :]) / (points[2:] - points[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(x: np.ndarray, rate: int, bands: int = 40, size: int = 1024, hop: int = 320) -> np.ndarray:
    """(frames, bands) log-mel image."""
    return np.log(frame_power(x, size, hop) @ mel_filters(bands, size, rate).T + 1e-6)


def mel_decibels(x: np.ndarray, rate: int, length: int, bands: int, size: int, hop: int) -> np.ndarray:
    """(bands, frames) power in dB of ``length`` samples around the middle of a clip, frames centred on their samples."""
    if len(x) >= length:
        x = x[(len(x) - length) // 2 :][:length]
    else:
        before = (length - len(x)) // 2
        x = np.pad(x, (before, length - len(x) - before))
    power = frame_power(np.pad(x, size // 2), size, hop) @ mel_filters(bands, size, rate).T
    return (10 * np.log10(np.maximum(power.T, 1e-10))).astype(np.float32)


# Edges of the bands (Hz) by which spectra are compared.
SPECTRUM_EDGES = (50, 150, 300, 500, 800, 1200, 1800, 2600, 3600, 5000, 7000, 8000)
# End of fixed values.


def realism(x: np.ndarray, rate: int) -> dict:
    """Crest factor, energy above 4 kHz, centroid, strongest modulation from 0.5 to 4 Hz, and log band levels."""
    if not len(x) or not np.any(x):
        return {"crest_db": None, "high_ratio": None, "centroid_hz": None, "modulation_hz": None, "bands": None}
    f, spectrum = np.fft.rfftfreq(len(x), 1 / rate), np.abs(np.fft.rfft(x))
    power = spectrum**2
    width = max(rate // 50, 1)
    envelope = np.convolve(np.abs(x), np.full(width, 1 / width), "same")
    wobble = np.abs(np.fft.rfft(envelope - envelope.mean()))
    slow = np.flatnonzero((f >= 0.5) & (f <= 4))
    head = x[: 3 * rate]
    level, at = np.abs(np.fft.rfft(head * np.hanning(len(head)))), np.fft.rfftfreq(len(head), 1 / rate)
    inside = [(at >= lo) & (at < hi) for lo, hi in zip(SPECTRUM_EDGES, SPECTRUM_EDGES[1:])]
    return {
        "crest_db": db(np.abs(x).max() / np.sqrt((x**2).mean())), "high_ratio": float(power[f >= 4000].sum() / power.sum()), "centroid_hz": float(f @ spectrum / spectrum.sum()),
        "modulation_hz": float(f[slow[wobble[slow].argmax()]]) if len(slow) else 0.0, "bands": [float(np.log(level[m].mean() + 1e-9)) if m.any() else 0.0 for m in inside],
    }


def features(x: np.ndarray, rate: int) -> dict[str, float]:
    """Level, shape and spectrum features of one segment."""
    p = frame_power(x, 1024, 512)
    f = np.fft.rfftfreq(1024, 1 / rate)
    total = p.sum(1) + 1e-12
    centroid = (p @ f) / total
    spread = np.sqrt(np.maximum(0, (p @ f**2) / total - centroid**2))
    cum = np.cumsum(p, 1) / total[:, None]
    flat = np.exp(np.log(p + 1e-12).mean(1)) / (p.mean(1) + 1e-12)
    mel = np.log(p @ mel_filters(26, 1024, rate).T + 1e-6)
    k = np.arange(26)
    dct = np.cos(np.pi / 26 * (k[:, None] + 0.5) * np.arange(13)[None, :])
    mfcc = mel @ dct
    rms = float(np.sqrt((x.astype(np.float64) ** 2).mean())) if len(x) else 0.0
    out = {
        "rms": rms, "peak": float(np.abs(x).max()) if len(x) else 0.0, "zcr": float((np.diff(np.signbit(x)) != 0).mean()) if len(x) > 1 else 0.0,
        "centroid": float(centroid.mean()), "bandwidth": float(spread.mean()), "rolloff": float(f[(cum >= 0.85).argmax(1)].mean()), "flatness": float(flat.mean()),
        "crest": float(np.abs(x).max() / rms) if rms else 0.0, "high_ratio": float(p[:, f >= 4000].sum() / p.sum()) if p.sum() else 0.0,
    }
    out |= {f"mfcc_{i}": float(v) for i, v in enumerate(mfcc.mean(0))}
    delta = np.diff(mfcc, axis=0).mean(0) if len(mfcc) > 1 else np.zeros(13)
    return out | {f"delta_{i}": float(v) for i, v in enumerate(delta)}


def fingerprint(x: np.ndarray, rate: int, bands: int = 16, steps: int = 32) -> bytes | None:
    """A bit per band and time step: above the band's median or not; None for a short clip."""
    if len(x) < 2048:
        return None
    p = frame_power(x, 1024, max(1, int(rate * 0.064)))
    edges = np.unique((512 * np.linspace(0, 1, bands + 1) ** 2).astype(int))
    image = 10 * np.log10(np.stack([p[:, a : max(b, a + 1)].mean(1) for a, b in zip(edges, edges[1:])], 1) + 1e-12)
    level = image.max(1)
    active = np.flatnonzero(level >= level.max() - 40)
    image = image[active[0] : active[-1] + 1]
    at = np.linspace(0, len(image) - 1, steps)
    image = np.stack([np.interp(at, np.arange(len(image)), c) for c in image.T], 1)
    return np.packbits(image > np.median(image, 0)).tobytes()


def rustle(numbers: np.ndarray, rate: int, sec: float = 2.0) -> np.ndarray:
    """Noise of ``sec`` seconds whose level in four bands follows the four quarters of ``numbers``; the same for the same numbers."""
    numbers = np.asarray(numbers, np.float64)
    n = int(sec * rate)
    spectrum = np.fft.rfft(np.random.default_rng(zlib.crc32(numbers.tobytes())).standard_normal(n))
    band = np.minimum(4 * np.arange(len(spectrum)) // len(spectrum), 3)
    out = np.zeros(n)
    for k, part in enumerate(np.array_split(numbers, 4)):
        level = np.interp(np.linspace(0, len(part) - 1, n), np.arange(len(part)), np.clip(part, -1, 1)) if len(part) else np.zeros(n)
        out += np.fft.irfft(spectrum * (band == k), n) * np.exp(6 * level)
    return (0.5 * out / max(np.abs(out).max(), 1e-12)).astype(np.float32)


def equal_bits(a: bytes, b: bytes) -> float:
    """Share of equal bits of two prints."""
    x = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8))
    return 1.0 - float(x.mean())


def unpacked(image: bytes, bands: int = 40) -> np.ndarray:
    """(frames, bands) of the packed doubles of ``log_mel``."""
    return np.frombuffer(image, np.float64).reshape(-1, bands)


def best_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Best correlation of two log-mel images as the shorter slides along the longer."""
    x, y = sorted((a, b), key=len)
    if len(x) < 10:
        return 0.0
    x = x - x.mean()
    best = 0.0
    for at in range(len(y) - len(x) + 1):
        w = y[at : at + len(x)]
        w = w - w.mean()
        best = max(best, float((x * w).sum() / (np.linalg.norm(x) * np.linalg.norm(w) + 1e-12)))
    return best


def aligned_correlation(a: np.ndarray, b: np.ndarray, rate: int) -> float:
    """Best correlation of the log-mel images of two clips."""
    return best_correlation(log_mel(a, rate), log_mel(b, rate))


def loudest_windows(x: np.ndarray, size: int, count: int) -> list[int]:
    """Starts of the loudest windows at half-window steps, loudest first, none overlapping another."""
    if len(x) <= size:
        return [0]
    starts = np.arange(0, len(x) - size + 1, max(1, size // 2))
    total = np.append(0, np.cumsum(x.astype(np.float64) ** 2))
    energy = total[starts + size] - total[starts]
    out: list[int] = []
    for s in starts[np.lexsort((starts, -energy))].tolist():
        if len(out) < count and all(abs(s - o) >= size for o in out):
            out.append(s)
    return out


def augment(x: np.ndarray, rate: int, recipe: str, seed: int, other: np.ndarray | None = None) -> np.ndarray:
    """One recipe, the same for the same seed; the result stays within full scale. ``overlay`` lays ``other`` under the clip, repeated or cut to its length, 5 to 20 dB quieter."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    level = np.sqrt((x**2).mean()) if len(x) else 0.0
    if recipe == "noise":
        spectrum = np.fft.rfft(rng.standard_normal(len(x)))
        pink = np.fft.irfft(spectrum / np.sqrt(np.maximum(np.fft.rfftfreq(len(x)), 1 / max(1, len(x)))), len(x))
        y = x + pink / max(np.sqrt((pink**2).mean()), 1e-12) * level / 10 ** (rng.uniform(5, 20) / 20)
    elif recipe == "overlay":
        if other is None or not len(other):
            raise ValueError("overlay needs another clip")
        under = np.resize(np.roll(other.astype(np.float64), int(rng.integers(0, len(other)))), len(x))
        y = x + under / max(np.sqrt((under**2).mean()), 1e-12) * level / 10 ** (rng.uniform(5, 20) / 20)
    elif recipe == "shift":
        y = np.roll(x, int(rng.integers(-len(x) // 4, len(x) // 4 + 1)))
    elif recipe == "volume":
        y = x * 10 ** (rng.uniform(-12, 6) / 20)
    elif recipe == "reverb":
        tail = rng.standard_normal(int(0.3 * rate)) * np.exp(-np.arange(int(0.3 * rate)) / (0.08 * rate))
        tail[0] = 1.0
        n = len(x) + len(tail) - 1
        y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(tail * 0.3, n), n)[: len(x)]
    elif recipe == "distance":
        f = np.fft.rfftfreq(len(x), 1 / rate)
        y = np.fft.irfft(np.fft.rfft(x) / (1 + (f / rng.uniform(2000, 5000)) ** 2), len(x)) * 0.5
    elif recipe == "device_band":
        f = np.fft.rfftfreq(len(x), 1 / rate)
        y = np.fft.irfft(np.fft.rfft(x) * ((f >= 300) & (f <= 3400)), len(x))
    elif recipe == "partial":
        keep = int(len(x) * rng.uniform(0.5, 0.9))
        start = int(rng.integers(0, len(x) - keep + 1))
        y = x[start : start + keep]
    else:
        raise ValueError(f"unknown recipe {recipe!r}")
    top = np.abs(y).max() if len(y) else 0.0
    return (y / top * 0.99 if top > 0.99 else y).astype(np.float32)
