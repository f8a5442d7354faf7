"""Hashed character n-grams of many strings at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multipliers of the rolling hash, one for each place in an n-gram.
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array, and the number of the string that each belongs to."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in texts])


def ngrams(points: np.ndarray, owner: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (of 2**bits) of the n-grams that lie inside one string, and their owners."""
    m = len(points) - n + 1
    if m <= 0:
        return np.empty(0, np.uint32), np.empty(0, np.int32)
    h = np.full(m, n * 0x5BD1E995 & 0xFFFFFFFF, dtype=np.uint32)
    for j in range(n):
        h ^= points[j : j + m] * FACTORS[j]
        h = (h << np.uint32(13)) | (h >> np.uint32(19))
    h *= np.uint32(0x2C1B3C6D)
    h >>= np.uint32(32 - bits)
    inside = owner[:m] == owner[n - 1 :]
    return h[inside], owner[:m][inside]


def chunks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole strings of about most characters each, with the place of the first; a longer string is alone."""
    first, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(x)
    if first < len(texts):
        yield first, texts[first:]
