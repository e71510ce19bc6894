"""Hashes of words and of word shingles, vectorised over many texts."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Words in a shingle.
SHINGLE = 5
_PLACES = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without space and U+0009 to U+000D, A-Z lower-cased) and where each text's words end."""
    raw = [t.encode("utf-8", "replace").lower() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    ends_of_text = np.cumsum([len(r) + 1 for r in raw])
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.arange(len(data))
    within = at - np.maximum.accumulate(np.where(first, at, 0))
    powers = np.cumprod(np.full(int(within.max()) + 1, _STEP, np.uint64))
    value = _BYTE[data] * powers[within]
    value[space] = 0
    return mixed(np.add.reduceat(value, starts)), np.searchsorted(starts, ends_of_text)


def shingles(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct shingle hashes in order; a text of fewer than SHINGLE words has its whole sequence as one, a text without words none."""
    words, ends = word_hashes(texts)
    n = len(words) - SHINGLE + 1
    rolled = np.zeros(max(0, n), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        rolled += words[k : k + n] * _PLACES[k]
    rolled = mixed(rolled)
    out, low = [], 0
    for high in ends.tolist():
        if high - low >= SHINGLE:
            out.append(np.unique(rolled[low : high - SHINGLE + 1]))
        elif high > low:
            out.append(mixed((words[low:high] * _PLACES[: high - low]).sum(dtype=np.uint64, keepdims=True) + np.uint64(high - low)))
        else:
            out.append(rolled[:0])
        low = high
    return out
