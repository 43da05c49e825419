"""Rolling hashes and minimizer anchors over arrays of units (bytes or words).

A document is an array of 64-bit unit values.  Window hashes are polynomial
hashes modulo 2**64 taken from one prefix sum, then mixed, so the hash of any
span costs two look-ups.  Spans stay far under 2**10 units, where such hashes are sound.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TOP = U(0xFFFFFFFFFFFFFFFF)
#: Longer words are hashed by BLAKE2: from 2**10 units on there are spans that a polynomial modulo 2**64 can't tell apart.
LONG_WORD = 500
#: The ASCII white space that separates words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stir(x: np.ndarray) -> np.ndarray:
    """A cheaper mixing, one to one, in place: enough to choose least hashes by."""
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    x *= U(0x94D049BB133111EB)
    return x


_BYTES = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_powers = (np.ones(1, U), np.ones(1, U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for exponents 0 to n at least."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16, 2 * len(_powers[0]) if n < 1 << 22 else n + 1)
        out = []
        for b in (_BASE, _BASE_INV):
            a = np.full(size, b, U)
            a[0] = 1
            out.append(np.cumprod(a, dtype=U))
        _powers = tuple(out)
    return _powers


def byte_units(data: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(data, np.uint8)]


def prefix(units: np.ndarray) -> np.ndarray:
    """Prefix sums s with s[i] = sum of units[t] * base**t for t < i."""
    s = np.zeros(len(units) + 1, U)
    np.cumsum(units * powers(len(units))[0][: len(units)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hashes of the spans [start, end)."""
    return (s[end] - s[start]) * powers(len(s))[1][start]


def all_windows(s: np.ndarray, k: int) -> np.ndarray:
    """Stirred hashes of every window of k units."""
    n = len(s) - k
    if n <= 0:
        return np.zeros(0, U)
    return stir((s[k:] - s[:n]) * powers(len(s))[1][:n])


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of a text."""
    space = SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def word_units(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word, the same for the same bytes."""
    if not len(starts):
        return np.zeros(0, U)
    size = ends - starts
    out = mix(span_hash(prefix(byte_units(data)), starts, ends) + size.astype(U))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def text_minimizers(s: np.ndarray, ends: np.ndarray, window: int, k: int) -> np.ndarray:
    """Positions in several joined texts that hold the least hash of k units in some window within one text.

    s are prefix sums over all texts, ends where each text ends."""
    w, n = window - k + 1, len(s) - 1
    if n < window:
        return np.zeros(0, np.int64)
    h = all_windows(s, k) & ~U(3)
    least = window_min(h, w)
    starts = np.concatenate(([0], ends[:-1]))
    mark = np.zeros(n + 1, np.int8)
    long = ends > starts
    np.add.at(mark, np.maximum(starts, ends - window + 1)[long], 1)
    np.add.at(mark, ends[long], -1)
    least[np.cumsum(mark[: len(least)], dtype=np.int8) > 0] = 0  # these windows reach into the next text
    m = np.zeros(len(h) + w - 1, U)
    m[w - 1 : w - 1 + len(least)] = least
    return np.flatnonzero((_slide(m, w, np.maximum) == h) & (h != 0))


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w neighbours, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = f(x[: len(x) - step], x[step:])
        have += step
    return x


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    return _slide(h, w, np.minimum)


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least hash of some w neighbours; all of equal ones.

    With fewer than w hashes there is no whole window and so no position."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    m = np.zeros(len(h) + w - 1, U)
    m[w - 1 : len(h)] = window_min(h, w)
    return np.flatnonzero(_slide(m, w, np.maximum) == h)
