"""DartMinHash: weighted minwise signatures by throwing hashed darts.

An element of weight w is the region [0, w) x [0, infinity) of weight and
rank.  Darts fall on it as a Poisson process that depends on the element's
hash alone, so equal regions of different sets catch equal darts.  Each dart
belongs to one of k coordinates by its hash; a set keeps, per coordinate, the
dart of lowest rank.  Two sets then agree in a coordinate with probability
equal to their weighted Jaccard similarity.  Rank is searched in strips from
0 up until every coordinate has a dart, about k ln k darts in all, so the cost
is that of hashing the elements a few times plus the darts, not elements
times k.

The weight axis is cut at 0, 1, 2, 4, 8 and so on; a region [0, w) is made of the pieces below w,
and of the darts on its last piece those at weights below w are its own.  So weights are any
positive numbers, an element is hashed once for each doubling of its weight, and equal parts of two
regions catch equal darts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_D = np.uint64(0xD6E8FEB86659FD93)
#: First strip: ranks below 2**-FINEST; each next one doubles the rank searched.
FINEST = 5
#: Cells hashed at once, times parts.
CELLS = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), on uint64."""
    x = (x + _C).astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


@lru_cache(maxsize=256)
def _poisson_steps(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson count, until they are 1 to double precision."""
    n = np.arange(int(mean + 12 * mean**0.5) + 30)
    logs = n * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(np.maximum(1, n[1:])))])
    return np.minimum(1.0, np.cumsum(np.exp(logs)))


def pieces(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the regions of elements (64-bit hashes) with positive weights: seed, width, share that is covered, element's place."""
    top = np.maximum(0, np.ceil(np.log2(np.maximum(weights, 1.0)))).astype(np.int64)
    place = np.repeat(np.arange(len(elements)), top + 1)
    strip = np.arange(len(place)) - np.repeat(np.cumsum(top + 1) - top - 1, top + 1)
    width = np.where(strip > 0, 2.0 ** (strip - 1), 1.0)
    covered = np.minimum(1.0, (weights[place] - np.where(strip > 0, width, 0.0)) / width)
    seed = elements.astype(np.uint64)[place]
    return np.where(strip > 0, mix64(seed + strip.astype(np.uint64) * _B), seed), width, covered, place


def cells(elements: np.ndarray) -> np.ndarray:
    """Unit cells of a multiset of 64-bit hashes: one hash for each (element, occurrence), sorted."""
    if not len(elements):
        return elements.astype(np.uint64)
    x = np.sort(elements.astype(np.uint64))
    new = np.concatenate([[True], x[1:] != x[:-1]])
    if not new.all():
        at = np.arange(len(x))
        nth = at - np.maximum.accumulate(np.where(new, at, 0))
        x = np.where(nth > 0, mix64(x + nth.astype(np.uint64) * _B), x)
        x.sort()
    return x


def signatures(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """k dart hashes for each of several weighted sets, given one after the other; none may be empty.

    Strips of rank are searched in order, so a coordinate that has a dart from
    an earlier strip keeps it, and a set that has all its darts drops out.
    """
    n = len(counts)
    best, filled = np.zeros(n * k, np.uint64), np.zeros(n * k, bool)
    piece, width, covered, place = pieces(elements, weights)
    owner = np.repeat(np.arange(n), counts)[place]
    low, strip = 0.0, 0
    while len(piece):
        high = 2.0 ** (strip - FINEST)
        whole = max(1, int(high - low))  # strips above rank 1 are cut into parts of height 1
        height = (high - low) / whole
        widths = [(w, np.flatnonzero(width == w)) for w in np.unique(width)]
        at_once = max(1, min(whole, CELLS // len(piece)))
        for first in range(0, whole, at_once):
            part = np.arange(first, min(whole, first + at_once))
            salt = mix64(((np.uint64(strip) << np.uint64(32)) + part.astype(np.uint64)) + np.uint64(1))
            found = [_darts(piece[at], covered[at], owner[at], salt, height * w, k) for w, at in widths]
            slot, dart, part_at = (np.concatenate(x) for x in zip(*found))
            new = ~filled[slot]
            slot, dart, part_at = slot[new], dart[new], part_at[new]
            rank = part[part_at] + _unit(mix64(dart ^ _C))
            last_wins = np.argsort(-rank, kind="stable")
            best[slot[last_wins]] = dart[last_wins]
            filled[slot] = True
        open_ = ~filled.reshape(n, k).all(axis=1)
        stay = open_[owner]
        piece, width, covered, owner = piece[stay], width[stay], covered[stay], owner[stay]
        low, strip = high, strip + 1
    return best.reshape(n, k)


def _darts(piece, covered, owner, salt, mean: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot (set and coordinate), hash and part of rank of all darts on pieces of one width, ``mean`` on each."""
    steps = _poisson_steps(mean)
    seed = mix64(piece[:, None] ^ salt)
    hit = np.flatnonzero(seed >= np.uint64(int(steps[0] * 2.0**64)))
    seed = seed.ravel()[hit]
    darts = np.maximum(np.searchsorted(steps, _unit(seed), "right"), 1)
    of = np.repeat(np.arange(len(hit)), darts)
    nth = (np.arange(len(of)) - np.repeat(np.cumsum(darts) - darts, darts)).astype(np.uint64)
    dart = mix64(seed[of] + (nth + np.uint64(1)) * _A)
    at, part_at = np.divmod(hit[of], len(salt))
    if (covered < 1).any():
        inside = (covered[at] >= 1) | (_unit(mix64(dart ^ _D)) < covered[at])
        dart, at, part_at = dart[inside], at[inside], part_at[inside]
    return owner[at] * k + (dart % np.uint64(k)).astype(np.int64), dart, part_at


def bands(sigs: np.ndarray, n_bands: int) -> np.ndarray:
    """One 64-bit key for each set and band of equal length."""
    rows = sigs.reshape(len(sigs), n_bands, -1)
    key = np.broadcast_to(mix64(np.arange(n_bands, dtype=np.uint64)), rows.shape[:2])
    for j in range(rows.shape[2]):
        key = mix64(key ^ rows[:, :, j])
    return key
