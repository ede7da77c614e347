"""Anchors: positions that equal byte strings choose alike.

Every window of ``WINDOW`` bytes chooses one anchor of ``ANCHOR`` bytes inside it, by its content
alone: the leftmost least hash among its short grams, taken modulo the number of places an anchor
can start at. Two equal windows so choose the same anchor at the same place, and about one position in
thirty is chosen by any window. The context of an anchor reaches as far as windows that may choose
it, so it holds every such window.
"""

from __future__ import annotations

import numpy as np
import xxhash

WINDOW = 100
ANCHOR = 56
GRAM = 11
REACH = WINDOW - ANCHOR
_PLACES = REACH + 1
_GRAMS = WINDOW - GRAM + 1
_BLOCK = 1 << 19
_C1, _C2, _C3 = (
    np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
)


def words_at(buffer: np.ndarray) -> np.ndarray:
    """Every run of 8 bytes of ``buffer`` as one little-endian number, overlapping, without a copy."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))


def gathered_hash(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes (a multiple of 8) from each position ``at``."""
    state = np.full(len(at), length, np.uint64)
    for offset in range(0, length, 8):
        state = (state ^ words[at + offset]) * _C1
        state ^= state >> np.uint64(29)
    state *= _C2
    return state ^ (state >> np.uint64(32))


def _chosen(words: np.ndarray, low: int, high: int) -> np.ndarray:
    """The anchor of each window that starts in ``low .. high - 1``."""
    count = high - low + _GRAMS - 1
    first, second = words[low:low + count], words[low + GRAM - 8:low + GRAM - 8 + count]
    least = (first * _C1) ^ ((second + _C3) * _C2)
    least ^= least >> np.uint64(31)
    least *= _C1
    where = np.arange(count, dtype=np.int32)
    span = 1
    while span < _GRAMS:
        step = min(span, _GRAMS - span)
        right = least[step:] < least[:-step]
        where = np.where(right, where[step:], where[:-step])
        least = np.minimum(least[step:], least[:-step])
        span += step
    starts = np.arange(high - low, dtype=np.int32)
    return low + starts + (where[: high - low] - starts) % _PLACES


def find_anchors(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted anchor positions of the texts ``buffer[starts[i]:ends[i]]``.

    ``buffer`` must have 16 spare bytes at its end.
    """
    long_ = ends - starts >= WINDOW
    edge = np.zeros(len(buffer) + 1, np.int8)
    np.add.at(edge, starts[long_], 1)
    np.add.at(edge, ends[long_] - WINDOW + 1, -1)
    valid = np.cumsum(edge, dtype=np.int8).astype(bool)
    words, found = words_at(buffer), []
    last = len(buffer) - 16 - WINDOW + 1
    for low in range(0, max(last, 0), _BLOCK):
        high = min(low + _BLOCK, last)
        mask = valid[low:high]
        if mask.any():
            chosen = _chosen(words, low, high)[mask]
            found.append(np.unique(chosen[np.diff(chosen, prepend=-1) != 0]))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def contexts(
    buffer: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each anchor's context starts and ends, cut at its text's ends, and its hash.

    ``starts`` and ``ends`` are those of the text each anchor lies in.
    """
    low, high = np.maximum(at - REACH, starts), np.minimum(at + WINDOW, ends)
    full = high - low == REACH + WINDOW
    hashes = np.empty(len(at), np.uint64)
    hashes[full] = gathered_hash(words_at(buffer), low[full], REACH + WINDOW)
    raw, cut = memoryview(buffer), np.flatnonzero(~full)
    hashes[cut] = [
        xxhash.xxh64_intdigest(raw[a:b], c - a) for a, b, c in
        zip(low[cut].tolist(), high[cut].tolist(), at[cut].tolist())
    ]
    return low, high, hashes
