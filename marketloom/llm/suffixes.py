"""Enhanced suffix array over many short byte strings, and its interval tree.

Only suffixes that can start a maximal repeat are sorted: those whose first bytes, as many as a repeat has at least,
come more than once by their hashes, behind different bytes. The hashes only leave suffixes out; prefixes are
compared byte by byte.
"""

from __future__ import annotations

import numpy as np

from marketloom.llm.anchors import words_at

_WORD = 8
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def window_hashes(buffer: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes (at least 8) from each position that has as many, by doubling."""
    hashes, span = words_at(buffer), _WORD
    while span < length:
        step = min(span, length - span)
        mixed = (hashes[:-step] * _C1) ^ hashes[step:]
        mixed ^= mixed >> np.uint64(29)
        hashes, span = mixed * _C2, span + step
    return hashes


def repeated_starts(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Positions with ``least`` bytes of their string left whose hash others share that have another byte before them.

    Where all that share a hash have the same byte before them, the repeat one byte longer says more. Two strings
    of one hash only keep more positions.
    """
    counts = np.maximum(ends - starts - least + 1, 0)
    at_start = np.cumsum(counts) - counts
    places = np.arange(counts.sum()) + np.repeat(starts - at_start, counts)
    before = buffer[places - 1].astype(np.int16)
    before[at_start[counts > 0]] = -1
    hashes = window_hashes(buffer, least)[places]
    order = np.argsort(hashes)
    hashes, before = hashes[order], before[order]
    alike = hashes[1:] == hashes[:-1]
    diverse = alike & ((before[1:] != before[:-1]) | (before[1:] < 0))
    group = np.cumsum(np.concatenate([[0], ~alike]))[:len(order)]
    wanted = np.zeros(len(order), bool)
    wanted[group[1:][diverse]] = True
    return places[np.sort(order[wanted[group]])]


def suffix_array(buffer: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at ``places`` in order of their first ``depth`` bytes."""
    words = words_at(buffer)
    return places[np.lexsort([words[places + k].byteswap() for k in reversed(range(0, depth, _WORD))])]


def common_prefixes(buffer: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes ``left[i]`` and ``right[i]``, up to about ``depth``."""
    words, length = words_at(buffer), np.zeros(len(left), np.int64)
    open_ = np.arange(len(left))
    for k in range(0, depth, _WORD):
        differ = words[left[open_] + k] ^ words[right[open_] + k]
        lowest = differ & (~differ + np.uint64(1))
        length[open_] += np.where(differ == 0, _WORD, np.bitwise_count(lowest - np.uint64(1)) // 8)
        open_ = open_[differ == 0]
    return length


def intervals(prefixes: np.ndarray, least: int) -> np.ndarray:
    """Rows ``(common prefix, first, last)`` of the interval tree, children before parents.

    ``prefixes[i]`` is the common prefix of the suffixes in places ``i`` and ``i + 1``. Only nodes
    of at least ``least`` bytes are made; the scan keeps the open ones on a stack.
    """
    nodes, stack, at = [], [], 0
    places = np.flatnonzero(prefixes >= least)
    for place, value in zip(places.tolist(), prefixes[places].tolist()):
        if place != at:
            while stack:
                top, first = stack.pop()
                nodes.append((top, first, at))
            at = place
        first = at
        while stack and stack[-1][0] > value:
            top, first = stack.pop()
            nodes.append((top, first, at))
        if not stack or stack[-1][0] < value:
            stack.append((value, first))
        at += 1
    while stack:
        top, first = stack.pop()
        nodes.append((top, first, at))
    return np.array(nodes, np.int64).reshape(-1, 3)


def maximal_repeats(
    buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, depth: int
) -> tuple[np.ndarray, np.ndarray]:
    """Maximal repeats of at least ``least`` bytes inside the strings ``buffer[starts:ends]``.

    The strings follow each other, each closed by one zero byte, hold no zero themselves and are shorter than
    ``depth``; ``buffer`` ends in spare zero bytes, at least twice ``depth`` of them.
    Returns the repeats as rows ``(length, first, last)`` and the suffix array of the suffixes that
    can start one (``repeated_starts``): occurrences of a repeat are the suffixes in places ``first .. last``, all of them. A node is left out if the same
    byte stands before every occurrence, since the repeat one byte longer then says more.
    """
    places = repeated_starts(buffer, starts, ends, least)
    if not len(places):
        return np.empty((0, 3), np.int64), places
    depth = min(depth, int((ends - starts).max()) + 1)
    order = suffix_array(buffer, places, depth)
    prefixes = common_prefixes(buffer, order[:-1], order[1:], depth)
    owner = np.searchsorted(starts, order, side="right") - 1
    left_over = ends[owner] - order
    prefixes = np.minimum(prefixes, np.minimum(left_over[:-1], left_over[1:]))
    nodes = intervals(prefixes, least)
    at_start = order == starts[owner]
    before = buffer[order - 1]
    new = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | at_start[1:])])
    diverse = (new[nodes[:, 2]] > new[nodes[:, 1]]) | at_start[nodes[:, 1]]
    return nodes[diverse], order
