"""SetSketch registers of shingle sets, and what is read from them.

A set's register i is floor(1 - log_b m_i), cut to 0..Q+1, where m_i is the least of exponential variates of rate
A drawn from the hashes of its elements: exponentially spaced minima.  Registers of a union are the
elementwise maxima, and two sets agree in a register about as often as their Jaccard similarity.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash

#: Base of the spacing, rate, and largest register value less one.
BASE = 1.02
RATE = 20.0
Q = 2046
BANDS = 48
ROWS = 6
REGISTERS = BANDS * ROWS

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_FINISH = np.uint64(0xD6E8FEB86659FD93)


def _stream(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, n, dtype=np.uint32)


_FLIP = _stream(REGISTERS, 11)
_FACTOR = _stream(REGISTERS, 12) | np.uint32(1)


class Shingler:
    """Sets of 64-bit hashes of the k-word shingles of texts."""

    def __init__(self, k: int, memory: int = 250_000):
        self.k, self.memory = k, memory
        self.known: dict[bytes, int] = {}

    def _words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.memory:
            known.clear()
        found = [known.get(w) for w in words]
        if None in found:
            for i, (w, h) in enumerate(zip(words, found, strict=True)):
                if h is None:
                    found[i] = known[w] = xxhash.xxh64_intdigest(w)
        return np.array(found, np.uint64)

    def shingles(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct hashes; ASCII letters count as lower case.  A shorter text is one shingle."""
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = self._words(words)
        k = min(self.k, len(words))
        n = len(words) - k + 1
        x = np.full(n, k, np.uint64)
        for i in range(k):
            x = (x ^ (x >> np.uint64(29))) * _MULTIPLY + h[i : i + n]
        x ^= x >> np.uint64(32)
        x *= _FINISH
        x ^= x >> np.uint64(32)
        x.sort()
        if n > 1:
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        return x


def digest(elements: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return xxhash.xxh3_128_digest(elements.tobytes())


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets, one row each."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    least = np.empty((REGISTERS, len(sets)), np.uint32)
    for i in range(REGISTERS):
        least[i] = np.minimum.reduceat((x ^ _FLIP[i]) * _FACTOR[i], starts)
    u = (least.T.astype(np.float64) + 0.5) / 2.0**32
    m = -np.log1p(-u) / RATE
    return np.clip(np.floor(1 - np.log(m) / math.log(BASE)), 0, Q + 1).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key of every band of every sketch."""
    x = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sketches), BANDS)).copy()
    parts = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    for i in range(ROWS):
        x = (x ^ (x >> np.uint64(29))) * _MULTIPLY + parts[:, :, i]
    x ^= x >> np.uint64(32)
    x *= _FINISH
    x ^= x >> np.uint64(32)
    return x.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 40) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches, from both register vectors and set sizes.

    With u, v the shares of the sizes and p(x) = -log_b(1 - x (b - 1) / b), registers of a pair differ up or
    down with p(u - v J) and p(v - u J); the log likelihood is concave in J and is maximised by section.
    """
    up = (a > b).sum(axis=1).astype(float)
    down = (a < b).sum(axis=1).astype(float)
    same = a.shape[1] - up - down
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE), 1e-12, 1 - 1e-12)

    def likelihood(j: np.ndarray) -> np.ndarray:
        x, y = p(u - v * j), p(v - u * j)
        return up * np.log(x) + down * np.log(y) + same * np.log(np.clip(1 - x - y, 1e-12, 1))

    low, high = np.zeros_like(u), top
    for _ in range(steps):
        left, right = low + (high - low) / 3, high - (high - low) / 3
        rising = likelihood(left) < likelihood(right)
        low, high = np.where(rising, left, low), np.where(rising, high, right)
    return (low + high) / 2
