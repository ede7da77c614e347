"""Alignment of two tokenizers' segmentations of the same bytes.

Each side has a token-byte incidence matrix, stored by rows (CSR): row ``i`` holds a one in the
column of each byte that token ``i`` covers. The row products of A with the transpose of B (Gustavson)
give the overlap links with the number of shared bytes. Offsets where tokens of both sides end cut
the bytes into groups; the products of the token-group incidence matrices give the links of
tokens that share a group. Texts of a chunk are laid end to end, so one product serves them all, and
no link crosses texts, since both sides end with each text.

How often an id pair is linked in the whole corpus is a sum over links. Two ids that end together
have bytes of which one is a suffix of the other, so there are at most as many pairs as the vocabularies
have suffixes: a bound that does not depend on the corpus.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.words import chunks
from marketloom.workspace import written

#: Texts are tokenised in chunks of so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Rows of a link table that are held at once.
LINK_ROWS = 1 << 18
_PAIR = np.int64(1 << 32)

_ROWS = (
    "task int, at bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_overlaps bigint, "
    "n_shared bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
)


# --------------------------------------------------------------------------- sparse matrices


@dataclass
class Csr:
    """A sparse matrix of ones by rows: row ``i`` has its columns at ``starts[i]:starts[i + 1]``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @classmethod
    def of_ranges(cls, ends: np.ndarray, width: int) -> Csr:
        """Row ``i`` covers the columns from the end of row ``i - 1`` to ``ends[i]``."""
        return cls(np.concatenate([[0], ends]), np.arange(width, dtype=np.int64), width)

    @classmethod
    def of_members(cls, columns: np.ndarray, width: int) -> Csr:
        """Row ``i`` has a one in ``columns[i]`` only."""
        return cls(np.arange(len(columns) + 1), columns.astype(np.int64), width)

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    @cached_property
    def transposed(self) -> Csr:
        """By counting sort of the columns; rows stay in order within a column."""
        rows = np.repeat(np.arange(self.height), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Csr(starts, rows[order], self.height)

    def rows(self, low: int, high: int) -> Csr:
        """The rows from ``low`` up to ``high``."""
        a, b = self.starts[low], self.starts[high]
        return Csr(self.starts[low:high + 1] - a, self.columns[a:b], self.width)

    def times(self, other: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gustavson's product: each row gathers the rows of ``other`` that its columns name.

        Returns the places that are not zero, by row and then column, with their values.
        """
        sizes = np.diff(other.starts)[self.columns]
        total = int(sizes.sum())
        rows = np.repeat(np.repeat(np.arange(self.height), np.diff(self.starts)), sizes)
        first = np.repeat(other.starts[self.columns] - (np.cumsum(sizes) - sizes), sizes)
        columns = other.columns[first + np.arange(total)]
        key = rows * np.int64(other.width) + columns
        if len(key) and (key[1:] < key[:-1]).any():
            key.sort()
        fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.zeros(0, np.int64)
        return key[fresh] // max(other.width, 1), key[fresh] % max(other.width, 1), np.diff(np.append(fresh, total))

    def row_sizes_of_product(self, other: Csr) -> np.ndarray:
        """How many ones each row gathers in the product, without making it."""
        sizes = np.concatenate([[0], np.cumsum(np.diff(other.starts)[self.columns])])
        return sizes[self.starts[1:]] - sizes[self.starts[:-1]]


# --------------------------------------------------------------------------- tokenizers


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies show for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokenizer:
    """A byte-level BPE vocabulary file (side A). Special tokens are plain text."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        letters = byte_letters()
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        special = {t["content"] for t in rules["added_tokens"] if t["special"]}
        vocab = rules["model"]["vocab"]
        ranks = {
            bytes(letters[c] for c in piece): i for piece, i in vocab.items() if piece not in special
        }
        merged = [m if isinstance(m, list) else m.split(" ") for m in rules["model"]["merges"]]
        order = [vocab[a + b] for a, b in merged]
        if order != sorted(order) or rules["normalizer"] or len(ranks) + len(special) < len(vocab):
            raise ValueError("ids are not in the order of the merges")
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for piece, i in ranks.items():
            self.bytes_of[i] = piece
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a space in front."""
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class PieceTokenizer:
    """A SentencePiece model file (side B), which puts a space in front itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        if self.model.is_control(i):
            return b""
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Side:
    """A tokenizer with the lengths and the printed ids of its vocabulary."""

    def __init__(self, tokenizer, behind_last: bytes) -> None:
        self.tokenizer, self.bytes_of = tokenizer, tokenizer.bytes_of
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        #: Two forms of each id: followed by a comma, and by what ends its side of a group.
        ids = [str(i).encode() for i in range(len(self.bytes_of))]
        self.printed = np.array([t for i in ids for t in (i + b",", i + behind_last)], object)

    def ids(self, texts: list[str], raw: list[bytes]) -> list[list[int]]:
        """The ids of each text; none where their joined bytes are not the text's."""
        found = self.tokenizer.encode(texts)
        of = self.bytes_of.__getitem__
        return [ids if b"".join(map(of, ids)) == b" " + text else [] for ids, text in zip(found, raw)]


# --------------------------------------------------------------------------- alignment


class Alignment:
    """The links of a chunk of texts, whose tokens are laid end to end."""

    def __init__(self, sides: tuple[Side, Side], texts: list[bytes]) -> None:
        plain = [t.decode() for t in texts]
        found = [s.ids(plain, texts) for s in sides]
        # a text that either side cannot spell, and an empty one, has no tokens on any side
        whole = [bool(t and a and b) for t, a, b in zip(texts, *found)]
        self.counts = [
            np.array([len(ids) if w else 0 for ids, w in zip(one, whole)], np.int64) for one in found
        ]
        self.ids = [
            np.array(list(itertools.chain.from_iterable(itertools.compress(one, whole))), np.int64)
            for one in found
        ]
        self.ends = [np.cumsum(s.lengths[i]) for s, i in zip(sides, self.ids)]
        self.width = int(self.ends[0][-1]) if len(self.ends[0]) else 0
        self.by_byte = [Csr.of_ranges(e, self.width) for e in self.ends]
        common = np.intersect1d(self.ends[0], self.ends[1], assume_unique=True)
        self.n_groups = len(common)
        #: The group of each token: the first common end that is not before its own.
        self.group = [np.searchsorted(common, e) for e in self.ends]
        self.by_group = [Csr.of_members(g, self.n_groups) for g in self.group]
        self.text = [np.repeat(np.arange(len(texts)), n) for n in self.counts]

    @cached_property
    def overlaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of A and B with the number of bytes they share."""
        return self.by_byte[0].times(self.by_byte[1].transposed)

    @cached_property
    def ending(self) -> tuple[np.ndarray, np.ndarray]:
        """Those overlap links whose byte ranges end together."""
        a, b, _ = self.overlaps
        together = self.ends[0][a] == self.ends[1][b]
        return a[together], b[together]

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tokens of A and B that share a group, some rows of the product at a time."""
        a, b = self.by_group[0], self.by_group[1].transposed
        sizes = np.cumsum(a.row_sizes_of_product(b))
        edges = (np.flatnonzero(np.diff(sizes // LINK_ROWS)) + 1).tolist()
        for low, high in zip([0, *edges], [*edges, a.height]):
            if high > low:
                rows, columns, _ = a.rows(low, high).times(b)
                yield rows + low, columns

    def printed(self, sides: tuple[Side, Side]) -> tuple[list[bytes], np.ndarray]:
        """Every printed id in the order of the groups, A before B, and where each text begins."""
        last = [np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in self.group]
        n = [np.bincount(g, minlength=self.n_groups) for g in self.group]
        before = np.concatenate([[0], np.cumsum(n[0] + n[1])])
        out = np.empty(len(self.ids[0]) + len(self.ids[1]), object)
        for one, lead in ((0, 0), (1, n[0])):
            g = self.group[one]
            rank = np.arange(len(g)) - (np.cumsum(n[one]) - n[one])[g]
            place = before[g] + rank + (lead[g] if one else 0)
            out[place] = sides[one].printed[2 * self.ids[one] + last[one]]
        return out.tolist(), np.concatenate([[0], np.cumsum(self.counts[0] + self.counts[1])])


def _sides(byte_path: str, pattern: str, piece_path: str) -> tuple[Side, Side]:
    return Side(ByteTokenizer(byte_path, pattern), b"|"), Side(PieceTokenizer(piece_path), b";")


def _aligned(byte_path: str, pattern: str, piece_path: str):
    """Per document: sizes, the groups' digest, and how often each id pair is linked."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(byte_path, pattern, piece_path)
        number, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low, texts in chunks(batch, 1, CHUNK_BYTES):
                found = Alignment(sides, texts)
                n, (a, b) = len(texts), found.ending
                shown, starts = found.printed(sides)
                digests = [
                    hashlib.sha256(b"".join(shown[x:y])[:-1]).hexdigest() if y > x else ""
                    for x, y in zip(starts.tolist(), starts[1:].tolist())
                ]
                text = found.text[0][a]
                # one entry a document and pair
                order = np.lexsort((found.ids[1][b], found.ids[0][a], text))
                pair = (found.ids[0][a] * _PAIR + found.ids[1][b])[order]
                text = text[order]
                fresh = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (text[1:] != text[:-1]))) \
                    if len(pair) else np.zeros(0, np.int64)
                offsets = np.searchsorted(text[fresh], np.arange(n + 1)).astype(np.int32)
                product = found.by_group[0].row_sizes_of_product(found.by_group[1].transposed)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, number, np.int32)), pa.array(at + np.arange(n)),
                    batch.column(0).slice(low, n), *[pa.array(c) for c in found.counts],
                    pa.array(np.bincount(found.text[0][a], minlength=n)),
                    pa.array(np.bincount(found.text[0][found.overlaps[0]], minlength=n)),
                    pa.array(np.bincount(found.text[0], weights=product, minlength=n).astype(np.int64)),
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(pair[fresh])),
                    pa.ListArray.from_arrays(
                        pa.array(offsets), pa.array(np.diff(np.append(fresh, len(pair))).astype(np.int32))
                    ),
                ], ["task", "at", "doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_shared",
                    "groups_sha256", "pairs", "times"])
                at += n

    return task


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count, best``: how many links hold each id pair, and whether no other pair of its B id has more.

    A pair is the A id times 2^32 plus the B id. There are at most as many pairs as suffixes of the two vocabularies.
    """
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    counts = links.groupBy(F.col("link.pairs").alias("pair")).agg(F.sum("link.times").alias("count"))
    counts = written(counts, "pair_counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    top = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("most"))
    return counts.join(top, b_id == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_report(docs: DataFrame, byte_path: str, pattern: str, piece_path: str) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``) with its sizes, links and corpus-wide counts.

    ``n_links`` and ``n_groups`` count links of tokens that end together and groups; ``n_overlaps`` and
    ``n_shared`` the links by shared bytes and by shared groups. ``n_best`` counts links whose pair is
    the most frequent of its B id (ties included), ``count_sum`` adds up the corpus-wide counts over links.
    Null and empty texts, and texts that either side does not spell out byte by byte, have zeros
    and an empty digest. Repeated rows and ids, and null ids, are documents of their own; texts of any length
    are aligned whole. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = written(
        _texts(docs).mapInArrow(_aligned(byte_path, pattern, piece_path), _ROWS), "aligned"
    )
    counts = pair_counts(rows)
    links = rows.select("task", "at", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "task", "at", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")
    )
    # the counts are bounded by the vocabularies, see pair_counts
    sums = links.join(F.broadcast(counts), "pair").groupBy("task", "at").agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    )
    named = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("n_links", "n_best", "count_sum")]
    return rows.drop("pairs", "times").join(sums, ["task", "at"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", *named, "groups_sha256", "n_overlaps", "n_shared"
    )


def alignment_links(docs: DataFrame, byte_path: str, pattern: str, piece_path: str) -> DataFrame:
    """``doc_id, kind, a, b, weight``: the links themselves, as places of tokens in their text.

    ``kind`` is ``overlap`` (``weight``: shared bytes) or ``group`` (1). Odd rows are treated as in
    ``alignment_report``.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(byte_path, pattern, piece_path)
        for batch in batches:
            for low, texts in chunks(batch, 1, CHUNK_BYTES):
                found = Alignment(sides, texts)
                first = [np.cumsum(n) - n for n in found.counts]
                a, b, weight = found.overlaps
                parts = [("overlap", a[i:i + LINK_ROWS], b[i:i + LINK_ROWS], weight[i:i + LINK_ROWS])
                         for i in range(0, len(a), LINK_ROWS)]
                shared = (("group", a, b, np.ones(len(a), np.int64)) for a, b in found.shared())
                for kind, a, b, weight in itertools.chain(parts, shared):
                    text = found.text[0][a]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(low + text)), pa.array([kind] * len(a), pa.string()),
                        pa.array(a - first[0][text]), pa.array(b - first[1][text]), pa.array(weight),
                    ], ["doc_id", "kind", "a", "b", "weight"])

    return _texts(docs).mapInArrow(task, "doc_id bigint, kind string, a bigint, b bigint, weight bigint")
