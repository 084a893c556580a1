"""Word shingles as sets of 64-bit fingerprints, computed a document at a time with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import worker_cache

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Fingerprint of each word; forgets all at ``limit`` words."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(worker_cache("word hashes", _WordHashes).__getitem__, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A fingerprint for each run of ``size`` words."""
    n = len(h) - size + 1
    out = mix(h[:n] + np.uint64(1))
    for k in range(1, size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k])
    return out


def shingle_set(utf8: bytes, size: int) -> np.ndarray:
    """The distinct shingles of ``size`` words, ascending; A-Z count as a-z. A shorter text is one shingle, one without words none."""
    h = word_hashes(utf8.lower().split())
    if not len(h):
        return h
    return np.unique(window_hashes(h, size) if len(h) >= size else window_hashes(h, len(h)))
