"""64-bit hashes of the words and shingles of a text, vectorised over its bytes.

The word rule: A-Z lower-cased, words are runs of bytes other than space and
0x09-0x0D (white space of other scripts is part of a word).  A word's hash is a
polynomial over its bytes, read off one running sum of the text and mixed, so a
text costs a fixed number of passes over an array and no Python step per word.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_PLACE = _RNG.integers(1, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have if len(have) <= 1 << 22 else have[:1 << 22]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """One hash for each word of the text, in order."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    solid = ~_WHITE[raw]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if solid[0]:
        edge = np.concatenate([[0], edge])
    if solid[-1]:
        edge = np.concatenate([edge, [len(raw)]])
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power(_BASE, len(raw)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(raw))[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole text if it has fewer; none without words."""
    words = word_hashes(text)
    width = min(size, len(words))
    if not width:
        return words
    n = len(words) - width + 1
    runs = words[:n] * _PLACE[0]
    for k in range(1, width):
        runs += words[k:n + k] * _PLACE[k]
    return np.unique(mix(runs + np.uint64(width)))
