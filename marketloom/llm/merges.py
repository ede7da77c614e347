"""Pair merging for many short words at once.

One row of a matrix is one word. In every step each row merges its best pair (lowest rank, then
leftmost), which is what an agenda per word would pop next, so the rows end as that agenda's would.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

NEVER = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.int64) << 32) | right


class Pairs:
    """Lookup of ``(left, right) -> rank``; ``merged[rank]`` is the symbol the pair becomes.

    Ranks are the positions of ``pairs`` in order of preference. Pairs of the first symbols, which every
    word starts with, are looked up in a square; the others in one hash table
    with linear probing.
    """

    def __init__(self, pairs: list[tuple[int, int, int]], first: int = 512) -> None:
        left, right, self.merged = (np.array(c, np.int32) for c in zip(*pairs))
        keys = _key(left, right)
        keys, at = np.unique(keys, return_index=True)
        self.first = first
        self.square = np.full(first * first, NEVER, np.int32)
        inner = (left[at] < first) & (right[at] < first)
        self.square[left[at][inner] * first + right[at][inner]] = at[inner]
        bits = int(4 * len(keys)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NEVER, np.int32)
        slot = self._slot(keys)
        while len(keys):
            slot, at_slot = slot & self.mask, self.keys[slot & self.mask]
            _, chosen = np.unique(np.where(at_slot == -1, slot, -1), return_index=True)
            chosen = chosen[at_slot[chosen] == -1]
            self.keys[slot[chosen]] = keys[chosen]
            self.ranks[slot[chosen]] = at[chosen]
            rest = np.delete(np.arange(len(keys)), chosen)
            keys, at, slot = keys[rest], at[rest], slot[rest]
            slot = np.where(self.keys[slot] == -1, slot, slot + 1)

    def share(self, ranks: np.ndarray) -> None:
        """Give pairs a common rank: ``ranks[i]``, a pair with the same result, instead of ``i``."""
        self.shared = np.append(ranks.astype(np.int32), NEVER)
        for table in (self.square, self.ranks):
            table[:] = self.shared[np.minimum(table, len(ranks))]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def look_first(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The same as ``look`` for pairs that are mostly among the first symbols."""
        inner = (left < self.first) & (right < self.first) & (left >= 0) & (right >= 0)
        if inner.all():
            return self.square[left * self.first + right]
        rank = np.empty(len(left), np.int32)
        rank[inner] = self.square[left[inner] * self.first + right[inner]]
        rank[~inner] = self.look(left[~inner], right[~inner])
        return rank

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``NEVER`` where there is none."""
        keys = _key(left, right)
        slot = self._slot(keys)
        there = self.keys[slot]
        rank = self.ranks[slot]
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            rank[open_] = self.ranks[slot[open_]]
            open_ = open_[(there != keys[open_]) & (there != -1)]
        return rank


Skip = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def merge_all(symbols: np.ndarray, pairs: Pairs, skip: Skip | None = None) -> np.ndarray:
    """Merge every row of ``symbols`` (padded with -1) to the end; returns the padded result.

    Symbols below -1 stand for something that never merges.

    ``skip(row, start, middle, end)`` tells which candidates are dropped for good; the last three are
    positions in the word as it came.
    """
    n, width = symbols.shape
    out = np.full((n, width), -1, np.int32)
    symbols = np.concatenate([symbols, np.full((n, 1), -1, np.int32)], axis=1).astype(np.int32)
    starts = None if skip is None else np.tile(np.arange(width + 2, dtype=np.int32), (n, 1))
    rows, columns = np.arange(n), np.arange(width, dtype=np.int32)

    def candidates(which, at, look=pairs.look):
        """Ranks of the pairs that start in column ``at`` of the given rows."""
        rank = look(symbols[which, at], symbols[which, at + 1])
        if skip is not None:
            live = np.flatnonzero(rank != NEVER)
            w, p = which[live], at[live]
            dropped = skip(rows[w], starts[w, p], starts[w, p + 1], starts[w, p + 2])
            rank[live[dropped]] = NEVER
        return rank

    rank = np.full((n, width), NEVER, np.int32)
    which, at = np.nonzero(symbols[:, 1:] != -1)
    rank[which, at] = candidates(which, at, pairs.look_first)
    while len(rows):
        best = rank.argmin(axis=1)
        every = np.arange(len(rows))
        lowest = rank[every, best]
        open_ = lowest != NEVER
        left = np.count_nonzero(open_)
        if left < len(rows):
            out[rows[~open_]] = symbols[~open_, :width]
            if not left:
                break
            symbols, rank, rows = symbols[open_], rank[open_], rows[open_]
            starts = None if skip is None else starts[open_]
            best, lowest, every = best[open_], lowest[open_], every[:left]
        symbols[every, best] = pairs.merged[lowest]
        behind = columns > best[:, None]
        symbols[:, :-1] = np.where(behind, symbols[:, 1:], symbols[:, :-1])
        symbols[:, -1] = -1
        rank[:, :-1] = np.where(behind[:, :-1], rank[:, 1:], rank[:, :-1])
        rank[:, -1] = NEVER
        if skip is not None:
            kept = columns < best[:, None]
            starts[:, 1:-1] = np.where(kept, starts[:, 1:-1], starts[:, 2:])
        inner = np.flatnonzero(best)
        for which, at in ((every, best), (inner, best[inner] - 1)):
            rank[which, at] = candidates(which, at)
    return out
