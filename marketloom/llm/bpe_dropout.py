"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A word's merges run on an agenda: best score first, then leftmost. With dropout each candidate merge is
skipped for good if a hash keyed by the seed, the word, the variant of this occurrence and the
candidate's place says so. The same key always gives the same segmentation, other keys vary it,
and every segmentation decodes to the text it came from.

Pieces never span a space that follows another character, so words are merged apart. Short words
run many at a time (``merges``), long ones on a heap; both give the agenda's result.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.merges import Pairs, merge_all

DROPOUT = 0.1
VARIANTS = 4
_SPACE = "▁"
_BATCHED_CHARS = 32
_BATCH_WORDS = 8192
_CACHED_WORDS = 300_000
_GROUP_CHARS = 1 << 20
_WORD = re.compile(" *[^ ]+| +")
_ODD = -1000
_MASK = (1 << 64) - 1
_MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def dropped(key, start, middle, end, dropout: float):
    """Whether the merge of ``[start, middle)`` and ``[middle, end)`` of a word is skipped.

    Takes arrays of unsigned 64-bit numbers, or single ints.
    """
    if isinstance(key, int):
        state = (key ^ (start * _MIX[0]) & _MASK ^ (middle * _MIX[1]) & _MASK ^ (end * _MIX[2]) & _MASK)
        state = (state ^ (state >> 31)) * _MIX[0] & _MASK
        state = (state ^ (state >> 29)) * _MIX[1] & _MASK
        return (state >> 11) < int(dropout * (1 << 53))
    a, b, c = (np.uint64(m) for m in _MIX)
    state = key ^ start.astype(np.uint64) * a ^ middle.astype(np.uint64) * b ^ end.astype(np.uint64) * c
    state = (state ^ (state >> np.uint64(31))) * a
    state = (state ^ (state >> np.uint64(29))) * b
    return (state >> np.uint64(11)) < np.uint64(int(dropout * (1 << 53)))


class Model:
    """A merge-type SentencePiece vocabulary with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = processor.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_ids = [0] * 256
        plain: dict[str, int] = {}
        for i in range(size):
            piece = processor.id_to_piece(i)
            if processor.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)):
                plain[piece] = i
                self.bytes_of[i] = piece.replace(_SPACE, " ").encode()
        if any(_SPACE in p.lstrip(_SPACE) for p in plain):
            raise ValueError("a piece spans a space inside; words cannot be encoded apart")
        # single characters come first so that most pairs of a new word are looked up in a square
        singles = sorted(p for p in plain if len(p) == 1)
        order = [*singles, *sorted((p for p in plain if len(p) > 1), key=plain.__getitem__)]
        self.symbols = {p.replace(_SPACE, " "): s for s, p in enumerate(order)}
        self.ids = np.array([plain[p] for p in order], np.int64)
        #: Ids of the symbols from -130 on, the negative ones of single bytes outside the vocabulary.
        self.all_ids = np.concatenate([[0], self.byte_ids[127::-1], [0], self.ids])
        self.letters = {p: s for p, s in self.symbols.items() if len(p) == 1}
        best_first = sorted(
            (p for p in plain if len(p) > 1), key=lambda p: (-processor.get_score(plain[p]), plain[p])
        )
        pairs = []
        for piece in best_first:
            piece = piece.replace(_SPACE, " ")
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs.append((left, right, self.symbols[piece]))
        self.pairs = Pairs(pairs, first=1024)
        # splits of one piece share its score, so they share its rank: the leftmost goes first
        merged = self.pairs.merged
        first = np.concatenate([[True], merged[1:] != merged[:-1]])
        self.pairs.share(np.maximum.accumulate(np.where(first, np.arange(len(merged)), 0)))
        self.rank_of = {(a, b): (int(self.pairs.shared[r]), m) for r, (a, b, m) in enumerate(pairs)}


class Encoder:
    """Encodes texts with dropout; the ids of seen words are kept for each variant."""

    def __init__(self, path: str, seed: int, dropout: float, variants: int) -> None:
        self.model, self.seed, self.dropout, self.variants = Model(path), seed, dropout, variants
        self.known: list[dict[str, bytes]] = [{} for _ in range(variants)]

    def words(self, text: str) -> list[str]:
        """The words of a text, each with the spaces before it; one space is put in front."""
        return _WORD.findall(" " + text) if text else []

    def variant_of(self, doc_id: int | None, count: int) -> list[int]:
        """Which variant each word occurrence of a document takes."""
        key = xxhash.xxh64_intdigest(str(doc_id), self.seed)
        at = np.arange(count, dtype=np.uint64) + np.uint64(key)
        at = (at ^ (at >> np.uint64(31))) * np.uint64(_MIX[0])
        return ((at >> np.uint64(40)) % np.uint64(self.variants)).tolist()

    def key(self, word: str, variant: int) -> int:
        return xxhash.xxh64_intdigest(word, self.seed * self.variants + variant)

    def symbols(self, word: str) -> list[int]:
        """Symbols of the characters; those outside the vocabulary are -2 and never merge."""
        return [self.model.letters.get(c, -2) for c in word]

    def by_agenda(self, word: str, key: int) -> bytes:
        """One word on a heap of candidate merges."""
        symbols = self.symbols(word)
        size = len(symbols)
        start, end = list(range(size)), list(range(1, size + 1))
        before, after = [i - 1 for i in range(size)], [i + 1 for i in range(size)]
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left] if left >= 0 else size
            if left < 0 or right >= size:
                return
            found = self.model.rank_of.get((symbols[left], symbols[right]))
            if found and not dropped(key, start[left], start[right], end[right], self.dropout):
                heapq.heappush(agenda, (found[0], left, right, end[right], found[1]))

        for i in range(size - 1):
            offer(i)
        live = [True] * size
        grown = [1] * size
        while agenda:
            _, left, right, to, merged = heapq.heappop(agenda)
            stale = not live[left] or right >= size or not live[right] or after[left] != right
            if stale or end[right] != to or self.model.rank_of.get(
                (symbols[left], symbols[right]), (0, -1)
            )[1] != merged:
                continue
            symbols[left], end[left], live[right] = merged, to, False
            grown[left] += grown[right]
            after[left] = after[right]
            if after[right] < size:
                before[after[right]] = left
            offer(before[left])
            offer(left)
        return self.ids_of(word, [(symbols[i], start[i]) for i in range(size) if live[i]])

    def ids_of(self, word: str, symbols: Iterable[tuple[int, int]]) -> bytes:
        out = []
        for symbol, at in symbols:
            if symbol >= 0:
                out.append(int(self.model.ids[symbol]))
            else:
                out += [self.model.byte_ids[b] for b in word[at].encode()]
        return np.array(out, "<u4").tobytes()

    def _batched(self, words: list[str], variant: int) -> dict[str, bytes]:
        found = {}
        words = sorted(words, key=len)
        for low in range(0, len(words), _BATCH_WORDS):
            some = words[low:low + _BATCH_WORDS]
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            flat = np.frombuffer("".join(some).encode("utf-32-le"), "<u4")
            letters, inverse = np.unique(flat, return_inverse=True)
            # a character outside the vocabulary never merges: one byte is -2 - byte, more are _ODD
            symbol = np.array([
                self.model.letters.get(chr(c), -2 - c if c < 128 else _ODD) for c in letters.tolist()
            ], np.int32)[inverse]
            if (symbol == _ODD).any():
                odd = set(np.repeat(np.arange(len(some)), lengths)[symbol == _ODD].tolist())
                found |= {some[i]: self.by_agenda(some[i], self.key(some[i], variant)) for i in odd}
                found |= self._batched([w for i, w in enumerate(some) if i not in odd], variant)
                continue
            row = np.repeat(np.arange(len(some)), lengths)
            column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            symbols = np.full((len(some), int(lengths.max())), -1, np.int32)
            symbols[row, column] = symbol
            skip = None
            if self.dropout:
                keys = np.array([self.key(w, variant) for w in some], np.uint64)

                def skip(rows, start, middle, end, keys=keys):
                    return dropped(keys[rows], start, middle, end, self.dropout)

            merged = merge_all(symbols, self.model.pairs, skip)
            kept = merged != -1
            ids = self.model.all_ids[merged[kept] + 130].astype("<u4").tobytes()
            ends = (np.cumsum(kept.sum(1)) * 4).tolist()
            found |= {w: ids[a:b] for w, a, b in zip(some, [0, *ends], ends)}
        return found

    def learn(self, words: Iterable[str], variants: Iterable[int]) -> None:
        """Encode the new ones among many word occurrences at once."""
        wanted: list[set[str]] = [set() for _ in range(self.variants)]
        words, variants = list(words), np.fromiter(variants, np.int64)
        for variant in range(self.variants):
            if len(self.known[variant]) > _CACHED_WORDS // self.variants:
                self.known[variant].clear()
            chosen = itertools.compress(words, (variants == variant).tolist())
            wanted[variant] = set(chosen).difference(self.known[variant])
            self.known[variant].update(self._batched(
                [w for w in wanted[variant] if len(w) <= _BATCHED_CHARS], variant
            ))

    def encode(self, words: list[str], variants: list[int]) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers, from its learned words."""
        known = self.known
        try:
            return b"".join([known[v][w] for w, v in zip(words, variants)])
        except KeyError:
            return b"".join([
                known[v][w] if w in known[v] else self.by_agenda(w, self.key(w, v))
                for w, v in zip(words, variants)
            ])

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids, without the space put in front."""
        table = self.model.bytes_of
        raw = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return raw[1:].decode("utf-8")


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
    edges = (np.flatnonzero(np.diff(sizes // _GROUP_CHARS)) + 1).tolist()
    for low, high in zip([0, *edges], [*edges, batch.num_rows]):
        if high > low:
            part = batch.slice(low, high - low)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def encoded(
    docs: DataFrame, model_path: str, seed: int = 1, dropout: float = DROPOUT,
    variants: int = VARIANTS, with_ids: bool = True,
) -> DataFrame:
    """``doc_id, ids, n_ids, ids_crc32, lossless`` of every row of ``docs``.

    ``lossless`` says that decoding the ids gave back the text. A null text has no ids and is
    null in ``ids``; its other columns are 0 and true. An empty text has no ids either, in an empty array. Rows
    that share ``doc_id`` and text get equal ids; a null ``doc_id`` is a key like any other. Texts
    of any length are encoded whole. Extra columns are ignored; an empty table gives an empty result.
    ``with_ids=False`` leaves the ids out and keeps their digest.
    """
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int64()),
              ("ids_crc32", pa.int64()), ("lossless", pa.bool_())]
    schema = pa.schema([f for f in fields if with_ids or f[0] != "ids"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path, seed, dropout, variants)
        for batch in batches:
            rows = []
            for doc_ids, texts in _groups(batch):
                words = [[] if t is None else encoder.words(t) for t in texts]
                picks = [encoder.variant_of(d, len(w)) for d, w in zip(doc_ids, words)]
                encoder.learn(
                    itertools.chain.from_iterable(words), itertools.chain.from_iterable(picks)
                )
                for doc_id, text, parts, pick in zip(doc_ids, texts, words, picks):
                    ids = encoder.encode(parts, pick)
                    row = {
                        "doc_id": doc_id, "n_ids": len(ids) // 4, "ids_crc32": zlib.crc32(ids),
                        "lossless": text is None or encoder.decode(ids) == text,
                    }
                    if with_ids:
                        row["ids"] = None if text is None else np.frombuffer(ids, "<i4")
                    rows.append(row)
            yield pa.RecordBatch.from_pydict(
                {n: [r[n] for r in rows] for n in schema.names}, schema
            )

    kinds = {"doc_id": "bigint", "ids": "array<int>", "n_ids": "bigint", "ids_crc32": "bigint",
             "lossless": "boolean"}
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        task, ", ".join(f"{n} {kinds[n]}" for n in schema.names)
    )


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, ids``; null ids give a null text."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path, 0, 0.0, 1)
        for batch in batches:
            texts = [
                None if ids is None else encoder.decode(np.array(ids, "<u4").tobytes())
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

    return rows.select("doc_id", "ids").mapInArrow(task, "doc_id bigint, text string")
