"""Packing token sequences by minimum bin slack.

Every document is tokenised whole and ends with an end id. Documents longer than a sequence are
cut; what is packed are the pieces' lengths, and there are at most ``capacity`` different ones.
So the plan is made on the histogram of lengths, which does not grow with the corpus: for one bin
at a time, subset sums over the lengths still available are kept as one bit set, the fullest
feasible combination is removed, and the same bin is repeated as often as the counts allow.
Pieces of one length are interchangeable; a piece finds its place from its rank among them.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.merges import Pairs, merge_all
from marketloom.workspace import written

CAPACITY = 4096
END_ID = 1
_CACHED_CHARS = 48
_CACHED_WORDS = 400_000
_NEW_WORDS = 8192
_LEARN_CHARS = 1 << 21
_LATIN_END = chr(0x250)
#: Lower-casing a whole word treats a final capital sigma unlike lower-casing its letters.
_FINAL_SIGMA = "\u03a3"
#: Characters that ``str.split`` takes for white space and the tokenizer does not.
_UNEVEN_SPACES = "\x1c\x1d\x1e\x1f"

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class WordwiseEncoder:
    """A byte-level pair-merging tokenizer with word ends, with the ids of seen words kept.

    Gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)``. White space separates words
    before anything else does in such a tokenizer, so words can be encoded apart, and new words are
    merged many at a time by the ranks of the tokenizer's own file. What could break this goes through the
    library instead: a whole text that spells out a special token or holds a separator the two sides
    see differently, and a word that is long or not in Latin script.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = [*special, *_UNEVEN_SPACES]
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        vocab, end = rules["model"]["vocab"], rules["model"]["end_of_word_suffix"]
        self.words = regex.compile(
            rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        )
        merges = [m.split(" ") if isinstance(m, str) else m for m in rules["model"]["merges"]]
        self.pairs = Pairs(
            [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        )
        shown = _byte_letters()
        self.inner = np.array([vocab[c] for c in shown], np.int32)
        self.last = np.array([vocab[c + end] for c in shown], np.int32)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _segments(self, segments: list[str]) -> dict[str, bytes]:
        """Ids of pieces that the word pattern has cut."""
        raw = [s.encode() for s in segments]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        found, order = {}, np.argsort(lengths, kind="stable")
        for low in range(0, len(order), _NEW_WORDS):
            some = order[low:low + _NEW_WORDS]
            long_ = lengths[some]
            flat = np.frombuffer(b"".join([raw[i] for i in some]), np.uint8)
            row = np.repeat(np.arange(len(some)), long_)
            starts = np.cumsum(long_) - long_
            column = np.arange(len(flat)) - starts[row]
            symbols = np.full((len(some), int(long_.max())), -1, np.int32)
            symbols[row, column] = self.inner[flat]
            symbols[np.arange(len(some)), long_ - 1] = self.last[flat[starts + long_ - 1]]
            merged = merge_all(symbols, self.pairs)
            kept = merged >= 0
            ends = np.cumsum(kept.sum(1)) * 4
            ids = merged[kept].astype("<u4").tobytes()
            for i, a, b in zip(some.tolist(), [0, *ends.tolist()], ends.tolist()):
                found[segments[i]] = ids[a:b]
        return found

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        found, parts = {}, {}
        for word in words:
            if len(word) > _CACHED_CHARS or not (word.isascii() or max(word) < _LATIN_END):
                found[word] = self._whole(word)
            elif not word.isalpha():
                parts[word] = self.words.findall(word)
        segments = {s for cut in parts.values() for s in cut}
        segments.update(w for w in words if w not in found and w not in parts)
        ids = self._segments(list(segments))
        for word, cut in parts.items():
            found[word] = b"".join([ids[s] for s in cut])
        return ids | found

    def learn(self, words: Iterable[str]) -> None:
        """Encode the new ones among many words at once."""
        if len(self.known) > _CACHED_WORDS:
            self.known.clear()
        new = set(words).difference(self.known)
        self.known.update(self._learn([w for w in new if len(w) <= _CACHED_CHARS]))

    def split(self, text: str) -> list[str]:
        """The words of a text; none if they may not be encoded apart."""
        if any(s in text for s in self.whole):
            return []
        return (text if _FINAL_SIGMA in text else text.lower()).split()

    def encode(self, text: str, words: list[str]) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers; ``words`` as split."""
        if not words:
            return self._whole(text)
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            new = self._learn(list(set(words).difference(self.known)))
            return b"".join([new[w] if w in new else self.known[w] for w in words])


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def in_groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts (null: empty) of consecutive rows, a bounded amount of text at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
    cuts = np.flatnonzero(np.diff(sizes // _LEARN_CHARS, prepend=0, append=-1))
    for low, high in zip([0, *(cuts + 1).tolist()], [*(cuts + 1).tolist(), batch.num_rows]):
        if low < min(high, batch.num_rows):
            part = batch.slice(low, high - low)
            yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """``(piece, start, length, crc32)`` of consecutive pieces of at most ``capacity`` ids."""
    step = 4 * capacity
    for piece, low in enumerate(range(0, len(ids), step)):
        part = ids[low:low + step]
        yield piece, low // 4, len(part) // 4, zlib.crc32(part)


def pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Pieces of every document, with the task (``_part``) and the rank in it (``_rank``) by length."""
    end = np.array([end_id], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordwiseEncoder(tokenizer_path)
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for ids, texts in in_groups(batch):
                split = [encoder.split(text) for text in texts]
                encoder.learn(itertools.chain.from_iterable(split))
                for doc_id, text, words in zip(ids, texts, split):
                    for piece in cut(encoder.encode(text, words) + end, capacity):
                        rows.append((doc_id, *piece, int(seen[piece[2]])))
                        seen[piece[2]] += 1
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(np.full(len(rows), part, np.int32))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "_rank", "_part"],
            )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        task, f"{PIECES}, _rank bigint, _part int"
    )


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``.

    Bit ``s`` of ``sums`` says that some combination adds up to ``s``. A length with many copies
    enters in groups of 1, 2, 4, ... copies. Long lengths come first; the search ends when
    ``room`` itself is reached.
    """
    sums, stages, within = 1, [], (1 << (room + 1)) - 1
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left:
            take = min(group, left)
            before = sums
            sums |= (sums << (take * length)) & within
            stages.append((length, take, before))
            left -= take
            group *= 2
        if sums >> room & 1:
            break
    total, chosen = sums.bit_length() - 1, {}
    for length, take, before in reversed(stages):
        if not before >> total & 1:
            total -= take * length
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``(lengths in the bin with their copies, number of such bins)`` until nothing is left."""
    counts = {n: c for n, c in counts.items() if c}
    bins = []
    while counts:
        first = max(counts)
        counts[first] -= 1
        chosen = fullest(counts, capacity - first)
        counts[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        times = min(counts[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        bins.append((chosen, times))
    return bins


def places(bins: list[tuple[dict[int, int], int]], capacity: int) -> np.ndarray:
    """Rows ``(length, first rank, copies a bin, first sequence, offset)``, by length and rank."""
    rows, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for chosen, times in bins:
        offset = 0
        for length, copies in sorted(chosen.items(), reverse=True):
            rows.append((length, int(used[length]), copies, sequence, offset))
            used[length] += copies * times
            offset += copies * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Place every token of every row of ``docs`` (``doc_id``, ``text``) in a sequence.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A null or
    empty text is its end id alone. Null and repeated ``doc_id`` are packed like any other row; ties
    between pieces of equal length are free. Texts of any length are tokenised whole. Extra columns are
    ignored; an empty table gives no piece.
    """
    table = written(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    by_task = table.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    histogram = by_task.groupBy("length").agg(F.sum("_rows").alias("n")).collect()
    where = places(plan_bins({r.length: r.n for r in histogram}, capacity), capacity)

    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = by_task.select(
        "length", "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    bits = 64 - int(capacity).bit_length() - 1
    keys = (where[:, 0] << bits) | where[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length = column["length"].to_numpy()
            rank = column["_at"].to_numpy()
            at = np.searchsorted(keys, (length << bits) | rank, side="right") - 1
            inside = rank - where[at, 1]
            copies = where[at, 2]
            yield pa.RecordBatch.from_arrays(
                [*[column[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")],
                 pa.array(where[at, 3] + inside // copies),
                 pa.array(where[at, 4] + inside % copies * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = table.join(before, ["length", "_part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_rank") + F.col("_before")).alias("_at"),
    )
    return ranked.mapInArrow(place, f"{PIECES}, sequence_id bigint, offset bigint")
