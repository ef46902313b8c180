"""Byte-pair merges of many words at once, in numpy.

Each word holds its symbols in a row of a matrix.  A round merges, in every row
that has a pair to merge, the leftmost of its pairs of the lowest rank, as the
library's queue does one word after another; a row without one is done.
"""

from __future__ import annotations

import numpy as np

#: Rank of a pair that is not merged.
NEVER = np.int32(2**31 - 1)
_EMPTY = np.uint32(2**32 - 1)
_FACTOR = np.uint32(2654435769)


class Merges:
    """``pairs`` of ids (n, 2), the best first, and the id each becomes; ids are below 65,535, pairs differ."""

    def __init__(self, pairs: np.ndarray, into: np.ndarray):
        keys = self._keys(pairs[:, 0], pairs[:, 1])
        bits = max(4, (4 * len(keys)).bit_length())
        self._shift = np.uint32(32 - bits)
        # open addressing with linear probing; the last slot is followed by room for the longest run
        self._slots, self._ranks = np.full((1 << bits) + len(keys) + 1, _EMPTY), np.full((1 << bits) + len(keys) + 1, NEVER)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self._slots[slot] == _EMPTY
            self._slots[slot[free]] = keys[left[free]]
            placed = self._slots[slot] == keys[left]
            self._ranks[slot[placed]] = left[placed]
            left, slot = left[~placed], slot[~placed] + 1
        self._into = into.astype(np.int32)

    @staticmethod
    def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _FACTOR) >> self._shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or ``NEVER``."""
        keys = self._keys(a, b)
        slot = self._slot(keys)
        found = self._slots[slot]
        out = np.where(found == keys, self._ranks[slot], NEVER)
        open_ = np.flatnonzero((found != keys) & (found != _EMPTY))
        while len(open_):
            at = slot[open_] = slot[open_] + 1
            found, wanted = self._slots[at], keys[open_]
            hit = found == wanted
            out[open_[hit]] = self._ranks[at[hit]]
            open_ = open_[~hit & (found != _EMPTY)]
        return out

    def apply(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, how many of each row) of ``symbols`` (rows, width), of which each row uses its first ``lengths`` (at least 1)."""
        rows, width = symbols.shape
        flat = symbols.astype(np.int32).reshape(-1)
        # ranks[i] is that of the pair that begins at place i; one more column ends the row
        ranks = np.full((rows, width), NEVER)
        real = np.arange(1, width) < lengths[:, None]
        ranks[:, :-1][real] = self.ranks(symbols[:, :-1][real], symbols[:, 1:][real])
        alive = np.arange(width) < lengths[:, None]
        after = np.tile(np.arange(1, width + 1, dtype=np.int16), (rows, 1)).reshape(-1)
        before = np.tile(np.arange(-1, width - 1, dtype=np.int16), (rows, 1)).reshape(-1)
        flat_ranks, flat_alive = ranks.reshape(-1), alive.reshape(-1)
        live = np.arange(rows)
        while len(live):
            best = ranks[live].argmin(axis=1)
            at = live * width + best
            rank = flat_ranks[at]
            go = rank != NEVER
            live, at, rank = live[go], at[go], rank[go]
            if not len(live):
                break
            base = live * width
            flat[at] = self._into[rank]
            gone = base + after[at]
            flat_alive[gone], flat_ranks[gone] = False, NEVER
            follows = after[gone]
            after[at], flat_ranks[at] = follows, NEVER
            more = np.flatnonzero(follows < lengths[live])
            here, there = at[more], base[more] + follows[more]
            before[there] = here - base[more]
            flat_ranks[here] = self.ranks(flat[here], flat[there])
            ahead = before[at]
            more = np.flatnonzero(ahead >= 0)
            there, here = at[more], base[more] + ahead[more]
            flat_ranks[here] = self.ranks(flat[here], flat[there])
        return flat[flat_alive], alive.sum(axis=1)
