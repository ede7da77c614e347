"""Ranked lexical search over a length-stratified index.

A document's score for an item depends on a term's frequency ``tf``, its weight ``w`` and the
document's length normaliser ``m``, a whole number. So documents are grouped by equal ``m``: within
such a stratum all postings of one ``tf`` have one impact, computed once, and the highest ``tf`` of
each term bounds what any of its documents can score. An item visits strata in order of these
bounds and stops when no bound reaches its k-th best score; equality still counts, since ties go
to the smaller id. Whatever is skipped cannot be in the result.

Strata are stored in slices of bounded size, one row each, so that a length that a third of all
documents share is many rows. The index holds every term of every document. Items are searched in
blocks of bounded size, each against all slices.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from marketloom.llm.words import chunks, count, cut
from marketloom.workspace import written

K = 10
#: A slice of a stratum holds about so many documents and so many words of them.
SLICE_ROWS = 512
SLICE_WORDS = 300_000
#: Items are searched in blocks of so many characters; a block is shipped to the tasks.
BLOCK_CHARS = 4_000_000
#: So many postings are held at once while their slices are visited in order of their bounds.
HELD_POSTINGS = 4_000_000

_COUNTED = "task int, at bigint, doc_id bigint, n bigint, terms array<string>, tfs array<int>"
_SLICES = (
    "m bigint, slice bigint, doc_ids array<bigint>, terms array<string>, dfs array<int>, "
    "run_starts array<int>, run_tfs array<int>, post_starts array<int>, posts array<int>"
)


@dataclass
class Index:
    """A stored index: a row per slice of a stratum, and the corpus totals.

    In a row, term ``i`` has the runs ``run_starts[i]`` to ``run_starts[i + 1]``, by falling tf; run
    ``r`` has tf ``run_tfs[r]`` and the documents ``posts[post_starts[r]]`` up to
    ``posts[post_starts[r + 1]]``, which are places in ``doc_ids``.
    """

    slices: DataFrame
    n_docs: int
    n_terms: int


def _lists(values: pa.Array, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values.cast(kind))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a task have each number of terms."""
    found: Counter[int] = Counter()
    for batch in batches:
        for _, texts in chunks(batch, 0):
            found.update(count(texts).tolist())
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["n", "docs"]
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each document with their frequencies; documents without terms go."""
    task, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        for low, texts in chunks(batch, 1):
            row, words = cut(texts)
            if not len(row):
                continue
            coded = words.dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            width = len(coded.dictionary)
            key, tf = np.unique(row * width + code, return_counts=True)
            n, distinct = np.bincount(row, minlength=len(texts)), np.bincount(key // width, minlength=len(texts))
            held = np.flatnonzero(n)
            terms = coded.dictionary.take(pa.array(key % width)).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(held), task, np.int32)), pa.array(at + held),
                batch.column(0).take(pa.array(low + held)).cast(pa.int64()), pa.array(n[held]),
                _lists(terms, distinct[held], pa.string()), _lists(pa.array(tf), distinct[held], pa.int32()),
            ], ["task", "at", "doc_id", "n", "terms", "tfs"])
            at += len(texts)


def _slice(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One slice of a stratum: postings by term, then by falling tf."""
    terms, tfs = rows["terms"].combine_chunks(), rows["tfs"].combine_chunks()
    row = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy())
    coded = terms.flatten().dictionary_encode()
    code, tf = coded.indices.to_numpy(), tfs.flatten().to_numpy()
    order = np.lexsort((row, -tf, code))
    code, tf, row = code[order], tf[order], row[order]
    fresh_term = np.concatenate([[True], code[1:] != code[:-1]])
    fresh_run = fresh_term | np.concatenate([[True], tf[1:] != tf[:-1]])
    runs, run_of_post = np.flatnonzero(fresh_run), np.cumsum(fresh_run) - 1
    term_starts = np.flatnonzero(fresh_term)

    def one(values) -> pa.Array:
        return _lists(pa.array(values), np.array([len(values)]), pa.int32())

    ids = rows["doc_id"].combine_chunks()
    words = coded.dictionary.take(pa.array(code[term_starts]))
    return pa.Table.from_arrays([
        pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int64()),
        _lists(ids, np.array([len(ids)]), pa.int64()), _lists(words, np.array([len(words)]), pa.string()),
        one(np.diff(np.append(term_starts, len(code)))), one(np.append(run_of_post[term_starts], len(runs))),
        one(tf[runs]), one(np.append(runs, len(code))), one(row),
    ], names=["m", "slice", "doc_ids", "terms", "dfs", "run_starts", "run_tfs", "post_starts", "posts"])


def build(docs: DataFrame) -> Index:
    """Index every row of ``docs`` (``doc_id``, ``text``).

    Rows are documents of their own, also with repeated or null ids. Null texts and texts
    without a term are in no stratum. Texts of any length are indexed whole. An empty table gives
    an empty index. Extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lengths = docs.select("text").mapInArrow(_lengths, "n bigint, docs bigint").filter("n > 0")
    lengths = written(lengths.groupBy("n").agg(F.sum("docs").alias("docs")), "lengths")
    total = lengths.agg(F.sum("docs").alias("docs"), F.sum(F.col("n") * F.col("docs")).alias("terms")).first()
    n_docs, n_terms = total["docs"] or 0, total["terms"] or 1
    m = F.expr(f"10 + (90 * n * {n_docs}L) div {n_terms}L").alias("m")
    strata = lengths.select(m, "n", "docs").groupBy("m").agg(F.ceil(F.greatest(
        F.sum("docs") / SLICE_ROWS, F.sum(F.col("n") * F.col("docs")) / SLICE_WORDS
    )).alias("n_slices"))
    # the normalisers of all documents add up to at most 100 each, so of N documents no more than
    # sqrt(200 N) have different ones: a table of that size is shipped, and no row is dealt by m alone
    dealt = docs.mapInArrow(_counted, _COUNTED).select(m, "*").join(F.broadcast(strata), "m")
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("task", "at"), "n_slices"))
    slices = dealt.select("m", "slice", "doc_id", "terms", "tfs").groupBy("m", "slice").applyInArrow(_slice, _SLICES)
    return Index(written(slices, "slices"), n_docs, n_terms)


@dataclass
class _Block:
    """Items of a bounded number of characters; their terms are places in one vocabulary."""

    item_ids: list
    numbers: np.ndarray
    vocabulary: pa.Array
    terms: np.ndarray
    starts: np.ndarray


def _blocks(items: DataFrame) -> Iterator[_Block]:
    """The items that have terms, block by block; the driver holds one block at a time."""
    ids, numbers, texts, size = [], [], [], 0
    for number, (item_id, text) in enumerate(items.toLocalIterator()):
        if text:
            ids.append(item_id)
            numbers.append(number)
            texts.append(text.encode())
            size += len(text)
        if size >= BLOCK_CHARS:
            yield _block(ids, numbers, texts)
            ids, numbers, texts, size = [], [], [], 0
    if ids:
        yield _block(ids, numbers, texts)


def _block(ids: list, numbers: list[int], texts: list[bytes]) -> _Block:
    row, words = cut(texts)
    coded = words.dictionary_encode()
    width = max(len(coded.dictionary), 1)
    key = np.unique(row * width + coded.indices.to_numpy().astype(np.int64))
    starts = np.searchsorted(key // width, np.arange(len(texts) + 1))
    return _Block(ids, np.array(numbers), coded.dictionary.cast(pa.string()), key % width, starts)


def _frequencies(index: Index, vocabulary: pa.Array) -> np.ndarray:
    """In how many documents each term of a block occurs."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            at = pc.index_in(batch.column(0).flatten(), value_set=vocabulary)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            np.add.at(found, at.drop_null().to_numpy(), batch.column(1).flatten().to_numpy()[known])
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held])], ["term", "df"])

    rows = index.slices.select("terms", "dfs").mapInArrow(task, "term bigint, df bigint")
    df = np.zeros(len(vocabulary), np.int64)
    for term, count in rows.groupBy("term").agg(F.sum("df")).collect():  # no more rows than terms
        df[term] = count
    return df


class _Stratum:
    """One slice in a task, seen through a block's vocabulary."""

    def __init__(self, row: dict[str, pa.Scalar], vocabulary: pa.Array, weights: np.ndarray) -> None:
        def ints(name):
            return row[name].values.to_numpy(zero_copy_only=False)

        m, runs = row["m"].as_py(), ints("run_starts")
        self.doc_ids, self.posts = row["doc_ids"].values, ints("posts")
        posts_of_run = ints("post_starts")
        tf = ints("run_tfs").astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
        self.impacts = np.repeat(impact, np.diff(posts_of_run))
        at = pc.index_in(row["terms"].values, value_set=vocabulary)
        here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        term = at.drop_null().to_numpy()
        self.low, self.high = (np.zeros(len(vocabulary), np.int64) for _ in range(2))
        self.low[term], self.high[term] = posts_of_run[runs[here]], posts_of_run[runs[here + 1]]
        self.most = np.zeros(len(vocabulary), np.int64)
        self.most[term] = weights[term] * impact[runs[here]]

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        scores = np.zeros(len(self.doc_ids), np.int64)
        for term in terms[self.most[terms] > 0].tolist():
            low, high = self.low[term], self.high[term]
            scores[self.posts[low:high]] += weights[term] * self.impacts[low:high]
        return scores


class _Best:
    """The k best documents of one item so far; null ids come last among ties."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores, self.ids, self.unnamed = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """What a document must reach to be considered."""
        return max(int(self.scores[-1]), 1) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, doc_ids: pa.Array) -> None:
        at = np.flatnonzero(scores >= self.least())
        if len(at) > self.k:  # with all that tie with the k-th
            at = at[scores[at] >= np.partition(scores[at], -self.k)[-self.k]]
        if not len(at):
            return
        ids = doc_ids.take(pa.array(at))
        scores = np.concatenate([self.scores, scores[at]])
        unnamed = np.concatenate([self.unnamed, ids.is_null().to_numpy(zero_copy_only=False)])
        ids = np.concatenate([self.ids, ids.fill_null(0).to_numpy()])
        order = np.lexsort((ids, unnamed, -scores))[:self.k]
        self.scores, self.ids, self.unnamed = scores[order], ids[order], unnamed[order]


def _visit(strata: list[_Stratum], best: list[_Best], terms: list[np.ndarray], weights: np.ndarray) -> None:
    """Score the slices for each item in order of their bounds, as far as the bounds can matter."""
    if not strata:
        return
    for mine, item_terms in zip(best, terms):
        bounds = np.array([s.most[item_terms].sum() for s in strata])
        for at in np.argsort(-bounds, kind="stable").tolist():
            if bounds[at] < mine.least():
                break
            mine.add(strata[at].scores(item_terms, weights), strata[at].doc_ids)


def _searched(index: Index, block: _Block, id_type: pa.DataType, kind: str, k: int) -> DataFrame:
    """The k best documents of each item of a block in every task."""
    df = _frequencies(index, block.vocabulary)
    weights = np.array(
        [math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64
    )
    terms = [block.terms[a:b] for a, b in zip(block.starts, block.starts[1:])]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in terms]
        strata, held = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(i)[at] for i, n in enumerate(batch.schema.names)}
                strata.append(_Stratum(row, block.vocabulary, weights))
                held += len(strata[-1].posts) + len(block.vocabulary)
                if held >= HELD_POSTINGS:
                    _visit(strata, best, terms, weights)
                    strata, held = [], 0
        _visit(strata, best, terms, weights)
        counts = [len(b.scores) for b in best]
        unnamed = np.concatenate([b.unnamed for b in best])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(block.numbers, counts)),
            pa.array(block.item_ids, id_type).take(pa.array(np.repeat(np.arange(len(best)), counts))),
            pa.array(np.concatenate([b.ids for b in best]), mask=unnamed),
            pa.array(np.concatenate([b.scores for b in best])),
        ], ["item", "item_id", "doc_id", "score"])

    found = index.slices.select(
        "m", "doc_ids", "terms", "run_starts", "run_tfs", "post_starts", "posts"
    ).mapInArrow(task, f"item bigint, item_id {kind}, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each row of ``items``.

    Items have ``item_id`` and ``text``; each row is answered on its own, also with a repeated or
    null id. Scores are above 0; equal ones go by ascending id, null ids last. An item without terms,
    or whose terms no document holds, has no rows; an empty table of items or documents gives an
    empty result. Long items are searched whole. Extra columns are ignored.
    """
    spark: SparkSession = items.sparkSession
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType
    id_type = to_arrow_type(kind)
    found = None
    for block in _blocks(items):
        ranked = _searched(index, block, id_type, kind.simpleString(), k)
        ranked = written(ranked.select("item_id", "rank", "doc_id", "score"), "ranked")
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        rest = [StructField(n, t()) for n, t in (("rank", IntegerType), ("doc_id", LongType), ("score", LongType))]
        return spark.createDataFrame([], StructType([StructField("item_id", kind), *rest]))
    return found
