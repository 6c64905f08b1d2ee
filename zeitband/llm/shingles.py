"""Word shingles of whole texts as sorted arrays of 64-bit hashes, computed for many texts at once.

Words are runs of other bytes than the six ASCII blanks, with A-Z in lower case. A word's hash is a polynomial over
its bytes; a shingle's hash mixes those of its words. A text of fewer words than a shingle takes is one shingle, and
a text without words has none. That two different shingles of one text or pair share a hash has a chance below
n * n / 2**64; nothing else here is approximate.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the multiplier, or of its inverse."""
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 16), _PRIME if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and how many each text has."""
    joined = b"\n".join(texts).lower() + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    blank = _BLANK[raw]
    solid = ~blank
    start = np.flatnonzero(solid & np.concatenate(([True], blank[:-1])))
    end = np.flatnonzero(blank & np.concatenate(([False], solid[:-1])))
    n = len(raw)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _power("up", n), dtype=np.uint64)))
    hashes = mix((sums[end] - sums[start]) * _power("down", n)[start] + (end - start).astype(np.uint64))
    edges = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(start, edges))))
    return hashes, counts


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    if not texts:
        return []
    words, counts = word_hashes(texts)
    n = len(words) - k + 1
    whole = np.zeros(0, np.uint64)
    if n > 0:
        whole = words[:n]
        for i in range(1, k):
            whole = mix(whole * _PRIME + words[i : i + n])
    sets, at = [], 0
    for c in counts:
        if c >= k:
            sets.append(np.unique(whole[at : at + c - k + 1]))
        elif c:
            h = np.array([c], np.uint64)
            for w in words[at : at + c]:
                h = mix(h * _PRIME + w)
            sets.append(h)
        else:
            sets.append(np.zeros(0, np.uint64))
        at += c
    return sets
