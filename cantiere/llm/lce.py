"""Longest common extensions in sequences of numbers, by a difference cover.

Every window of ``PERIOD`` positions holds the residues of the cover so that for any two positions some shift below
``PERIOD`` moves both onto sampled ones. Only sampled suffixes (5 of 21) are sorted, by doubling within
their residue; a query compares the few words up to the shared shift and asks a sparse table over the common
prefixes of neighbouring samples for the rest.
"""

from __future__ import annotations

import numpy as np

#: fixed values: a difference cover; every residue modulo 21 is a difference of two of its members
PERIOD, COVER = 21, (0, 1, 4, 14, 16)


def _shifts() -> np.ndarray:
    """Smallest shift that moves two residues into the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    places = np.arange(PERIOD)
    both = inside[(places[:, None, None] + places) % PERIOD] & inside[(places[None, :, None] + places) % PERIOD]
    if not both.any(axis=2).all():
        raise ValueError("not a difference cover")
    return both.argmax(axis=2)


SHIFTS = _shifts()


def _dense(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by keys (most significant first), and the rank of every row, equal rows alike."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    for key in keys:
        change[1:] |= key[order][1:] != key[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(change)
    return order, rank


class Extensions:
    """``codes``: numbers from 0; a separator must be a number that occurs once."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        highest = int(codes.max(initial=0))
        # numbers of their own behind the end: no comparison leaves the sequence
        self.codes = np.concatenate([codes, highest + 1 + np.arange(2 * PERIOD)]).astype(np.int64)
        inside = np.zeros(PERIOD, bool)
        inside[list(COVER)] = True
        at = np.flatnonzero(np.resize(inside, self.n + PERIOD))
        self.slot = np.full(len(self.codes) + 1, -1, np.int64)
        self.slot[at] = np.arange(len(at))
        levels, order = self._sorted(at, max(1, int(self.codes[-1]).bit_length()))
        self.rank = levels[-1]
        common = self._common(at, order, levels)
        del levels
        self.least = [common]
        width = 1
        while 2 * width <= len(common):
            below = self.least[-1]
            self.least.append(np.minimum(below[:-width], below[width:]))
            width *= 2

    def _sorted(self, at: np.ndarray, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Ranks of the samples by their first PERIOD, 2 * PERIOD, ... words until all differ, and the final order."""
        per_key, keys = max(1, 62 // bits), []
        for first in range(0, PERIOD, per_key):
            key = np.zeros(len(at), np.int64)
            for k in range(first, min(first + per_key, PERIOD)):
                key = (key << bits) | self.codes[at + k]
            keys.append(key)
        order, rank = _dense(keys)
        levels, reach = [rank], PERIOD
        while len(rank) and rank.max() + 1 < len(rank):
            ahead = self.slot[np.minimum(at + reach, len(self.slot) - 1)]
            order, rank = _dense([rank, np.where(ahead >= 0, rank[ahead], -1)])
            levels.append(rank)
            reach *= 2
        return levels, order

    def _common(self, at: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each sample in order with its predecessor."""
        left, right = at[order[:-1]], at[order[1:]]
        same = np.zeros(len(left), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            rank, a, b = levels[k], self.slot[left + same], self.slot[right + same]
            same += np.where((a >= 0) & (b >= 0) & (rank[a] == rank[b]), PERIOD << k, 0)
        live = np.arange(len(left))
        for _ in range(PERIOD):  # the rest is shorter than the first rank's words
            live = live[self.codes[left[live] + same[live]] == self.codes[right[live] + same[live]]]
            if not len(live):
                break
            same[live] += 1
        return same

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from each i and j on (i differs from j)."""
        shift = SHIFTS[i % PERIOD, j % PERIOD]
        out, live = np.zeros(len(i), np.int64), np.arange(len(i))
        reached = []
        for step in range(PERIOD):
            due = shift[live] == step
            reached.append(live[due])
            live = live[~due]
            live = live[self.codes[i[live] + step] == self.codes[j[live] + step]]
            if not len(live):
                break
            out[live] = step + 1
        live = np.concatenate(reached)
        if len(live):
            a, b = (self.rank[self.slot[x[live] + shift[live]]] for x in (i, j))
            low, high = np.minimum(a, b), np.maximum(a, b)  # the least of common[low:high]
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            found = np.empty(len(live), np.int64)
            for k in np.unique(level).tolist():
                one = level == k
                found[one] = np.minimum(self.least[k][low[one]], self.least[k][high[one] - (1 << k)])
            out[live] = shift[live] + found
        return out
