"""Fuzzy keys of 64-bit fingerprints by the binary Golay code of length 23.

The code is perfect: every 23-bit word is within three errors of one codeword.  The keys of a word
are the codewords that the word and its 23 neighbours decode to (one, or six if the word itself has
three errors); two words that differ in at most two bits have a neighbour in common, hence a key.

A fingerprint has segments of 23, 23 and 18 bits.  Let two fingerprints differ in at most four bits.
If a segment is equal, one of the other two has at most two errors: key (equal segment, Golay key of
the other).  If none is equal, two segments have one error each, so a half of each is equal, and the
third has at most two: key (the two halves, Golay key of the third).  So such fingerprints share a key.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101

#: (first bit, bits) of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word, and the error of each syndrome."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = [remainder(1 << i) for i in range(23)]
    low = np.zeros(1 << 12, np.int32)
    high = np.zeros(1 << 11, np.int32)
    for i in range(12):
        low[np.arange(1 << 12) >> i & 1 == 1] ^= single[i]
    for i in range(11):
        high[np.arange(1 << 11) >> i & 1 == 1] ^= single[12 + i]
    error = np.zeros(1 << 11, np.int32)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for i in bits:
                syndrome ^= single[i]
            error[syndrome] = sum(1 << i for i in bits)
    return low, high, error


def decode(words: np.ndarray) -> np.ndarray:
    """Index (the 12 information bits) of the nearest codeword of each 23-bit word."""
    low, high, error = tables()
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def fuzzy(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of words whose bits past ``bits`` are always zero."""
    near = np.concatenate([[0], 1 << np.arange(bits, dtype=np.int32)]).astype(np.int32)
    keys = np.sort(decode(words[:, None] ^ near[None, :]), axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    rows, columns = np.nonzero(new)
    return rows, keys[rows, columns]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of unsigned 64-bit fingerprints; keys are exact, not hashed."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int32) for at, n in SEGMENTS]
    cut = [(x & 0xFFF, x >> 12) if n == 23 else (x & 0x1FF, x >> 9) for x, (_, n) in zip(parts, SEGMENTS)]
    rows_out, keys_out, kind = [], [], 0
    for t, (_, bits) in enumerate(SEGMENTS):
        rows, code = fuzzy(parts[t], bits)
        a, b = (s for s in range(3) if s != t)
        beside = [parts[a].astype(np.int64), parts[b].astype(np.int64)]
        beside += [x.astype(np.int64) << 12 | y for x in cut[a] for y in cut[b]]
        for x in beside:
            rows_out.append(rows)
            keys_out.append(np.int64(kind) << 48 | x[rows] << 12 | code)
            kind += 1
    return np.concatenate(rows_out), np.concatenate(keys_out)
