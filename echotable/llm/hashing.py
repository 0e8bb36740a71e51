"""Vectorised hashing of words and word shingles over the bytes of an Arrow string column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
_BYTE = (_rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[_LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLOT = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """Powers of the multiplier, wrapped to 64 bits; grown when a longer word appears."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers), 4096), _STEP, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the offsets of each; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, so that temporary arrays stay small."""
    out, at = [], 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        out.append((at, to))
        at = to
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each text the index of its first word (one more at the end)."""
    ends = offsets[1:-1]
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    inner = ends[(ends > 0) & (ends < len(data))]
    first[inner] = ~space[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    gaps = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, gaps)
    value = _BYTE[data[starts[0] :]]
    value[space[starts[0] :]] = 0
    value *= powers(int(gaps.max()) + 1)[place]
    return mix(np.add.reduceat(value, starts - starts[0])), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, n: int, most: int = 1 << 19):
    """Yield ``(row, sorted distinct uint64 shingle hashes)`` for each text of the column.

    A text with fewer than ``n`` words gives one shingle of all its words; one without words
    gives an empty array.
    """
    data, offsets = utf8(column)
    for lo, hi in spans(offsets, most):
        part = offsets[lo : hi + 1]
        words, at = word_hashes(data[part[0] : part[-1]], part - part[0])
        count = np.diff(at)
        full = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            full += words[k : k + len(full)] * _SLOT[k]
        full = mix(full)
        for row in range(hi - lo):
            a, c = at[row], count[row]
            if c >= n:
                yield lo + row, np.unique(full[a : a + c - n + 1])
            elif c:
                yield lo + row, mix(np.array([(words[a : a + c] * _SLOT[:c]).sum() + np.uint64(c)], np.uint64))
            else:
                yield lo + row, full[:0]
