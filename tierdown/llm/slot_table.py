"""A minimal perfect hash of 128-bit digests, with the digests kept for verification.

Keys are spread over a bit array; those that are alone at their place are settled, the
others go on to the next, smaller array. A settled key's slot is the number of settled
places before its own, so ``n`` keys fill the slots ``0 .. n - 1`` exactly, and lookup is a
few array reads for all keys at once. A digest that was never put in finds a slot that
holds another one, and is told apart by it.
"""

from __future__ import annotations

import numpy as np

from tierdown.llm.words import mixed

_LOAD = 2  # places a key at each level
_LEVELS = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


class SlotTable:
    """``hi`` and ``lo``: the digests by slot, as unsigned 64-bit halves."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        """The digests must be distinct; ``distinct`` makes them so."""
        self.places: list[np.ndarray] = []  # slot at each place of a level, -1 where empty
        n, left = len(hi), np.arange(len(hi))
        slots = np.full(n, -1, np.int64)
        settled = 0
        for level in range(_LEVELS):
            if not len(left):
                break
            size = max(1, _LOAD * len(left))
            place = _place(hi[left], lo[left], level, size)
            alone = np.bincount(place, minlength=size) == 1
            ranks = np.cumsum(alone) - 1 + settled
            self.places.append(np.where(alone, ranks, -1))
            here = alone[place]
            slots[left[here]] = ranks[place[here]]
            settled += int(alone.sum())
            left = left[~here]
        if len(left):
            raise ValueError("digests are not distinct")
        self.hi, self.lo = np.empty(n, np.uint64), np.empty(n, np.uint64)
        self.hi[slots], self.lo[slots] = hi, lo

    def __len__(self) -> int:
        return len(self.hi)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that are not in the table."""
        found = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for level, places in enumerate(self.places):
            slot = places[_place(hi[left], lo[left], level, len(places))]
            found[left[slot >= 0]] = slot[slot >= 0]
            left = left[slot < 0]
        known = found >= 0
        same = (self.hi[found[known]] == hi[known]) & (self.lo[found[known]] == lo[known])
        found[np.flatnonzero(known)[~same]] = -1
        return found


def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    code = mixed(hi ^ mixed(lo + np.uint64(level + 1) * _ODD))
    return (code % np.uint64(size)).astype(np.int64)


def distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    return hi[new], lo[new]
