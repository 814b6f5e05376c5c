"""Hashes of words, for the operators on shingles and n-grams."""

from __future__ import annotations

import numpy as np

#: Texts of more bytes are hashed in parts, so memory is bounded by a part (or by one word).
PART_BYTES, PART_WORDS = 1_000_000, 100_000

_SEPARATORS = [9, 10, 11, 12, 13, 32]
_INSIDE = np.ones(256, bool)
_INSIDE[_SEPARATORS] = False
#: A number for each byte, equal in all processes: nought for separators, A-Z as a-z.
_NUMBERS = np.random.default_rng(1931).integers(0, 1 << 64, 256, np.uint64)
_NUMBERS[_SEPARATORS] = 0
_NUMBERS[65:91] = _NUMBERS[97:123]
_BASE = 0x9E3779B97F4A7C17  # odd, so it has an inverse
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """The first n powers (at least) of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, PART_BYTES)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(raw: bytes) -> np.ndarray:
    """The words' polynomials over the numbers of their bytes, mixed: sums over the whole text,
    each taken back by its word's place."""
    x = np.frombuffer(raw, np.uint8)
    begins = _INSIDE[x]
    begins[1:] &= ~begins[:-1]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.empty(0, np.uint64)
    up, down = powers(len(x))
    return mixed(np.add.reduceat(_NUMBERS[x] * up[: len(x)], first) * down[first])


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z in lower case; words stand between U+0020 and U+0009-D."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= PART_BYTES:
        return _hashes(raw)
    words = raw.split()
    return np.concatenate([np.empty(0, np.uint64), *(_hashes(b" ".join(words[i : i + PART_WORDS])) for i in range(0, len(words), PART_WORDS))])


def shingles(words: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of each different run of `n` words; shorter texts are one run, empty ones none."""
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(words) < n:
        words = np.concatenate([words, np.zeros(n - len(words), np.uint64)])
    runs = len(words) - n + 1
    x = np.zeros(runs, np.uint64)
    for i in range(n):
        x = (x ^ words[i : i + runs]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return np.unique(mixed(x), return_counts=True)
