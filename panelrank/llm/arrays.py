"""Text as byte arrays: many texts side by side, words and n-grams hashed without a Python loop."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def powers(n: int, sign: int = 1) -> np.ndarray:
    """The first ``n`` powers of the hash base (of its inverse for sign -1)."""
    have = _powers[sign]
    if len(have) < n:
        have = np.full(max(n, 2 * len(have)), _BASE if sign > 0 else _INVERSE, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 22:
            _powers[sign] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, a blank after each text, and where each text starts (with the end as last)."""
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    return data, np.concatenate([[0], np.cumsum(sizes)])


def runs(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest stretches of one kind other than 0: starts, ends and a hash of their bytes."""
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate([np.zeros(min(1, len(kind)), np.int64), edge])
    ends = np.concatenate([edge, np.full(min(1, len(kind)), len(kind), np.int64)])
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=prefix[1:])
    hashes = (prefix[ends] - prefix[starts]) * powers(len(data) + 1, -1)[starts]
    return starts, ends, mix(hashes)


def per_text(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Index ranges of the runs of each text: text i has runs out[i] to out[i + 1]."""
    return np.searchsorted(starts, bounds)


def sums(values: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """Sum of values[ranges[i]:ranges[i + 1]] for every i, zero where that is empty.

    A range's sum depends on its own values only, not on what lies beside it.
    """
    out = np.zeros((len(ranges) - 1, *values.shape[1:]))
    full = np.flatnonzero(ranges[1:] > ranges[:-1])
    if len(full):
        out[full] = np.add.reduceat(
            values[: ranges[-1]], ranges[full], axis=0, dtype=np.float64
        )
    return out
