"""Word and shingle hashes of many texts at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes hashed together; one longer text makes a chunk of its own.
CHUNK = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
                dtype=np.uint64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n + 1 of each."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def chunks(texts: Sequence[bytes | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most ``limit`` bytes together, or of one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for many spans of one byte array."""
    power, inverse = _tables(len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    each = np.add(values, 1, dtype=np.uint64)
    each *= power[: len(values)]
    np.cumsum(each, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(texts: Sequence[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's words start (one more entry than texts)."""
    joined = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", dtype=np.uint8)
    if lower:
        joined = joined + ((joined - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))  # A-Z; smaller bytes wrap round
    blank = (joined == 0x20) | (joined - np.uint8(9) < 5)
    edge = np.flatnonzero(np.append(True, blank[:-1]) != blank)  # starts and ends take turns, and the last byte is blank
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return span_hashes(joined, starts, ends), np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of the whole sequence if it is shorter; nothing without words."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        return mixed((words * _MIX[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = np.zeros(n - size + 1, dtype=np.uint64)
    for j in range(size):
        total += words[j : n - size + 1 + j] * _MIX[j]
    return mixed(total)
