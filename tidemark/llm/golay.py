"""The binary Golay code [23, 12, 7] as a fuzzy hash of 23-bit words.

The code is perfect: every word is at most 3 bits from exactly one codeword.
A word's keys are the indices of all codewords within 4 bits of it: one if the
nearest is at most 2 bits away, six if it is 3 away. Two words that differ in
at most one bit share a key, as the nearest codeword of either is at most
3 + 1 bits from the other.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS = 23
#: Generator polynomial of the code (fixed value).
GENERATOR = 0b110001110101
MOST_KEYS = 6


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - 11
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of each byte at each of three places; per remainder the error
    patterns of at most 4 bits that cause it, -1 where there are fewer than six."""
    parts = np.array([[_remainder(b << 8 * place & 0x7FFFFF) for b in range(256)] for place in range(3)], dtype=np.int64)
    errors: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(BITS), weight):
            error = sum(1 << b for b in bits)
            errors[_remainder(error)].append(error)
    padded = np.full((2048, MOST_KEYS), -1, dtype=np.int64)
    for i, found in enumerate(errors):
        padded[i, : len(found)] = found
    return parts, padded


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word the indices (12 bits) of its codewords, and which of the six are set."""
    parts, errors = _tables()
    words = words.astype(np.int64)
    rest = parts[0][words & 255] ^ parts[1][words >> 8 & 255] ^ parts[2][words >> 16]
    error = errors[rest]
    return (words[:, None] ^ error) >> 11, error >= 0
