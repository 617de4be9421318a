"""Vectorised word and shingle hashes over batches of UTF-8 text.

A word is a run of bytes that are no ASCII white space; A-Z count as a-z. Hashes are 64 bits wide.
"""

from __future__ import annotations

import numpy as np

from .common import SPACES

_rng = np.random.Generator(np.random.PCG64(20240131))
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random number for each byte, the same for both cases, 0 for white space.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] | np.uint64(1)
_BYTE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.multiply.accumulate(np.full(64, _BASE))
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.full(max(n, 2 * len(_powers)), _BASE))
    return _powers


def run_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each run of ``values`` (uint64); runs begin at ``starts`` and reach to the next one."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = np.diff(np.append(starts, len(values)))
    place = np.arange(len(values)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(values * powers(int(lengths.max()))[place], starts))


def word_starts(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in the bytes of a batch, and how many words lie before each row, with the total last."""
    word = ~_SPACE[raw]
    fresh = np.ones(len(raw) + 1, bool)
    fresh[1:-1] = ~word[:-1]
    fresh[at] = True
    starts = np.flatnonzero(word & fresh[:-1])
    return starts, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a batch of texts, and how many words lie before each text, with the total last."""
    starts, bounds = word_starts(raw, at)
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    first = starts[0]
    return run_hashes(_BYTE[raw[first:]], starts - first), bounds


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct k-word shingles.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    words, bounds = word_hashes(raw, at)
    n = len(words)
    joined = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        joined += mix(words[j : j + len(joined)] ^ _PLACE[j]) * _PLACE[j]
    joined = mix(joined)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(joined[a : b - k + 1]))
        elif b > a:
            part = words[a:b]
            out.append(mix(np.array([np.sum(mix(part ^ _PLACE[: b - a]) * _PLACE[: b - a]) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
