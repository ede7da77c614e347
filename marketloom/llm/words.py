"""Lower-cased words of many texts at once, cut on their UTF-8 bytes.

A word is a maximal run of digits, letters A to Z and characters beyond ASCII; only A to Z are
lower-cased. All bytes of a character beyond ASCII are at least 128, so words can be cut by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 22
_SPACE = 0x20


def _folding() -> bytes:
    """For each byte: itself in lower case if it belongs to a word, else a space."""
    table = bytearray([_SPACE]) * 128 + bytearray(range(128, 256))
    for first, last in ("09", "az", "AZ"):
        for byte in range(ord(first), ord(last) + 1):
            table[byte] = ord(chr(byte).lower())
    return bytes(table)


FOLDING = _folding()


def folded(text: bytes) -> bytes:
    """The text with words in lower case and a space for every other byte."""
    return text.translate(FOLDING)


def chunks(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``limit`` bytes, each with the row it starts at; null is empty.

    A text is never cut: one longer than ``limit`` is in a chunk of at most twice its size.
    """
    texts = batch.column(column).cast(pa.binary()).fill_null(b"")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    edges = (np.flatnonzero(np.diff(sizes // limit)) + 1).tolist()
    for low, high in zip([0, *edges], [*edges, batch.num_rows]):
        if high > low:
            yield low, texts.slice(low, high - low).to_pylist()


def _places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes of texts laid end to end, where words start and end, and the text of each."""
    joined = np.frombuffer(folded(b" ".join(texts) + b" "), np.uint8)
    edges = np.flatnonzero(np.diff(joined != _SPACE, prepend=False))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    starts = edges[::2]
    return joined, starts, edges[1::2], np.searchsorted(text_ends, starts, side="right")


def count(texts: list[bytes]) -> np.ndarray:
    """The number of words of each text."""
    return np.bincount(_places(texts)[3], minlength=len(texts))


def cut(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The text each word is in, and the words, in order."""
    joined, starts, ends, text = _places(texts)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = joined[joined != _SPACE]
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    )
    return text, words
