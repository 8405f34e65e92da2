"""Content-chosen positions: each stretch of so many bytes holds one whose choice depends on the stretch alone."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a position.
GRAM = 32
#: Positions handled at once; a longer text goes in overlapping blocks.
BLOCK = 1 << 19
_LOW = np.uint64((1 << 20) - 1)

_seed = np.random.default_rng(20240229)
_TABLE = _seed.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [int(x) * 2 + 1 for x in _seed.integers(1 << 60, 1 << 62, 8, dtype=np.int64)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position, by doubling."""
    h, size, k = _TABLE[data], 1, 0
    while size < GRAM:
        h = h[:-size] * np.uint64(_ODD[k]) + h[size:]
        size, k = size * 2, k + 1
    h ^= h >> np.uint64(29)
    h *= np.uint64(_ODD[6])
    return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(text: bytes, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (ascending) and hashes: of each stretch's grams, the rightmost of those with the least hash."""
    data = np.frombuffer(text, np.uint8)
    width = stretch - GRAM + 1
    if len(data) < stretch:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, values = [], []
    for start in range(0, len(data) - stretch + 1, BLOCK):
        h = gram_hashes(data[start : start + BLOCK + stretch - 1])
        order = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        least = _sliding_min(order, width)
        new = np.empty(len(least), bool)
        new[0] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        at = (_LOW - (least[new] & _LOW)).astype(np.int64)
        places.append(at + start)
        values.append(h[at])
    place, value = np.concatenate(places), np.concatenate(values)
    if len(places) > 1:
        place, first = np.unique(place, return_index=True)
        value = value[first]
    return place, value
