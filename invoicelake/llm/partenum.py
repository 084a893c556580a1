"""PartEnum signatures for exact set-similarity joins by Jaccard.

Sizes are cut into bands whose ends grow by 1 / threshold, so that sets similar enough lie in one band or in two adjoining.
Instance i joins the sets of bands i - 1 and i; within it, similar sets differ in at most

    k = floor((1 - t) / (1 + t) * 2 * (largest size of band i))

elements. The feature domain is partitioned into n1 * n2 parts (first level n1, second level n2), and within each first-level part,
every subset of n2 - k2 second-level parts is enumerated; the elements that fall into it, hashed, are a signature. As
n1 * (k2 + 1) > k, at least one first-level part holds at most k2 of the differences, and one of its subsets none: two similar
sets share that signature.

Subsets that hold no element of a set would make signatures that unrelated sets share. ``spare`` first-level parts more than
needed leave 1 + spare parts with an agreeing subset. A set in which at most ``spare`` first-level parts have an empty subset
leaves out its empty signatures and still shares another one; a set with more such parts keeps them. Two sets that agree in
nothing but empty subsets both have more than ``spare`` such parts, so no pair is lost.

``sketch`` has the parity of the number of elements in each of at least as many cells as the set has elements: sets whose sketches
differ in more than k bits differ in more than k elements, which rules out most pairs that share a signature by chance, and
never a similar one. A longer sketch folds to a shorter one's length.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

from .shingles import mix


@lru_cache(None)
def bands(percent: int) -> list[int]:
    """The largest size of each band; integer arithmetic, so that no similar pair falls between bands."""
    ends = [1]
    while ends[-1] < 1 << 50:
        ends.append(max(ends[-1] + 1, ends[-1] * 100 // percent))
    return ends


@lru_cache(None)
def plan(top: int, percent: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare) of the instance whose largest set has ``top`` elements.

    Up to three differences, one first-level part whose subsets leave out as many second-level parts; beyond, pairs of
    second-level parts, which keeps the number of signatures near k + 4.
    """
    k = (100 - percent) * 2 * top // (100 + percent)
    if k < 1:
        return 1, 1, 0, 0
    if k < 4:
        return 1, k + 2, k, 0
    return k // 2 + 2, 2, 1, 1


def band_of(size: int, percent: int) -> int:
    ends = bands(percent)
    lo, hi = 0, len(ends) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        if ends[mid] >= size:
            hi = mid
        else:
            lo = mid + 1
    return lo


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """Distinct 64-bit signatures of a set of distinct 64-bit elements; none for the empty set."""
    if not len(elements):
        return np.empty(0, np.uint64)
    band = band_of(len(elements), percent)
    out = [_instance(elements, i, percent) for i in (band, band + 1)]
    return np.unique(np.concatenate(out))


def _instance(elements: np.ndarray, instance: int, percent: int) -> np.ndarray:
    n1, n2, k2, spare = plan(bands(percent)[instance], percent)
    where = (mix(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5 + instance)) >> np.uint64(11)) % np.uint64(n1 * n2)
    sums = np.zeros(n1 * n2, np.uint64)
    np.add.at(sums, where.astype(np.int64), mix(elements + np.uint64(instance)))
    counts = np.bincount(where.astype(np.int64), minlength=n1 * n2)
    sums, counts = sums.reshape(n1, n2), counts.reshape(n1, n2)
    tag = np.uint64(instance << 40)
    out = []
    hollow = np.zeros(n1, bool)
    for c, subset in enumerate(combinations(range(n2), n2 - k2)):
        cols = list(subset)
        held = counts[:, cols].sum(1)
        sig = mix(sums[:, cols].sum(1, dtype=np.uint64) ^ mix(tag + np.arange(n1, dtype=np.uint64) * np.uint64(256) + np.uint64(c)))
        out.append((sig, held))
        hollow |= held == 0
    keep_empty = hollow.sum() > spare
    return np.concatenate([s if keep_empty else s[h > 0] for s, h in out])



def sketch(elements: np.ndarray) -> np.ndarray:
    """Words of 64 parity bits; a power of two of them, 8 at least."""
    bits = max(512, 1 << max(len(elements) - 1, 0).bit_length())
    cells = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((cells & 1).astype(np.uint8)).view("<u8")


def folded(words: np.ndarray, length: int) -> np.ndarray:
    """A sketch at a shorter length: cells are low bits of the elements, so equal remainders add up."""
    return np.bitwise_xor.reduce(words.reshape(-1, length), axis=0)
