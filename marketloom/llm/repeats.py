"""Removal of repeated passages from a corpus, exact to the byte.

A byte goes if it lies in a string of ``WINDOW`` bytes that also starts earlier, in a smaller
``doc_id`` or earlier in the same text. The work is split so that no text is compared as a whole:

1. Every map task finds its texts' anchors (``anchors``). Occurrences with equal contexts in one
   chunk are settled on the spot, so a passage copied everywhere sends one row per chunk.
2. Occurrences meet by anchor. In each group of equal contexts all but the earliest are removed
   over the whole context; where an anchor has several contexts, the earliest of each goes on.
3. The contexts of those are cut from their texts and meet by anchor again. An enhanced suffix
   array is scanned for the interval tree of common prefixes; each maximal repeat gives all its
   occurrences, and all but the earliest are removed over the repeat's length.
4. Removed stretches are joined to the texts.

An anchor that a bounded share of a fixed sample of the texts holds (a licence line in a third of
all documents) would be one big group with a different context each time. Such anchors are dealt out by
context in step 2. In step 3 every anchor with many contexts, counted exactly, is divided: a context becomes
two pieces that overlap by a window less one byte, pieces meet by the bytes that all their windows hold, equal pieces
are settled by their earliest, and parts that are still large are halved again. The result is the same either way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.anchors import (
    ANCHOR, REACH, WINDOW, contexts, find_anchors, gathered_hash, words_at,
)
from marketloom.llm.names import fresh
from marketloom.llm.suffixes import maximal_repeats
from marketloom.workspace import written

SAMPLE_SHARE = 64
FREQUENT_AT_LEAST = 16
FREQUENT_AT_MOST = 200_000
_CHUNK_BYTES = 1 << 22
_SUFFIX_BYTES = 1 << 19
_TASK_CONTEXTS = 20_000
# Contexts of one anchor, and pieces of one part, that are searched together at most.
GROUP_CONTEXTS = 2_048
_SPARE = 16
_NO_ID = (1 << 63) - 1

_DOC = "doc bigint, mark bigint"
_OCCURRENCE = f"route bigint, anchor bigint, context bigint, {_DOC}, low int, high int, at int, kind int"
_KINDS = _OCCURRENCE.replace("context bigint, ", "").replace("route bigint, ", "")
_REMOVED, _SEEN, _CONTEXT, _FREQUENT = 0, 1, 2, 3

Batches = Iterator[pa.RecordBatch]


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc``, ``mark`` and the bytes of each row; a text's hash tells rows of one id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"),
        F.xxhash64(text).alias("mark"),
        text.cast("binary").alias("body"),
    )


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``doc, mark, buffer, starts, ends`` of consecutive rows with a bounded number of bytes."""
    sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    edges = np.flatnonzero(np.diff(total // _CHUNK_BYTES)) + 1
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)]):
        if high > low:
            bodies = batch.column(2).slice(low, high - low).to_pylist()
            buffer = np.frombuffer(b"".join([*bodies, bytes(_SPARE)]), np.uint8)
            ends = np.cumsum(sizes[low:high])
            yield (
                batch.column(0).slice(low, high - low).to_numpy(),
                batch.column(1).slice(low, high - low).to_numpy(),
                buffer, ends - sizes[low:high], ends,
            )


def _united(doc, mark, low, high):
    """Ranges per document with overlaps and neighbours joined."""
    order = np.lexsort((high, low, mark, doc))
    doc, mark, low, high = doc[order], mark[order], low[order], high[order]
    if not len(doc):
        return doc, mark, low, high
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])
    group = np.cumsum(other)
    lift = group * (int(high.max()) + 1)
    reach = np.maximum.accumulate(high + lift) - lift
    new = other.copy()
    new[1:] |= low[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], mark[first], low[first], reach[last]


def _batch(schema: str, **columns) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    size = max(len(c) for c in columns.values() if not np.isscalar(c))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, columns.get(n, 0)) if np.isscalar(columns.get(n, 0)) else columns[n],
                  types[t]) for n, t in fields],
        [n for n, _ in fields],
    )


def _first_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Which sorted rows differ from the row before in any of the columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _repeats_first(new: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Which sorted rows equal the first row of their run in all columns: rows that came twice."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return np.logical_and.reduce([c == c[first] for c in columns])


def _occurrences(frequent: np.ndarray) -> Callable[[Batches], Batches]:
    """Step 1: anchors of each chunk, the earliest per context; ranges of the others."""
    def task(batches: Batches) -> Batches:
        for batch in batches:
            for doc, mark, buffer, starts, ends in _chunks(batch):
                at = find_anchors(buffer, starts, ends)
                if not len(at):
                    continue
                text = np.searchsorted(starts, at, side="right") - 1
                low, high, context = contexts(buffer, at, starts[text], ends[text])
                anchor = gathered_hash(words_at(buffer), at, ANCHOR).view(np.int64)
                context = context.view(np.int64)
                base = starts[text]
                order = np.lexsort((at - base, mark[text], doc[text], context, anchor))
                new = _first_of_runs(anchor[order], context[order])
                at_home = at - base
                twice = _repeats_first(new, doc[text[order]], mark[text[order]], at_home[order])
                gone, kept = order[~twice], order[new]
                d, m, a, b = _united(
                    doc[text[gone]], mark[text[gone]], low[gone] - base[gone],
                    high[gone] - base[gone],
                )
                if len(d):
                    yield _batch(_OCCURRENCE, route=d * 31 + m, doc=d, mark=m, low=a, high=b,
                                 kind=_REMOVED)
                hot = np.isin(anchor[kept], frequent)
                route = np.where(hot, anchor[kept] ^ context[kept], anchor[kept])
                yield _batch(
                    _OCCURRENCE, route=route, anchor=anchor[kept], context=context[kept],
                    doc=doc[text[kept]], mark=mark[text[kept]], low=low[kept] - base[kept],
                    high=high[kept] - base[kept], at=at[kept] - base[kept],
                    kind=np.where(hot, _FREQUENT, _SEEN),
                )

    return task


def _whole_groups(batches: Batches, key: str, most_rows: int) -> Iterator[pa.Table]:
    """Tables of consecutive sorted rows; the rows of one key are never parted."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < most_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield table.slice(0, last)
        held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _settled(batches: Batches) -> Batches:
    """Step 2: ranges removed by equal contexts, and the earliest of each context left open."""
    for table in _whole_groups(batches, "route", 1 << 17):
        c = {n: table.column(n).to_numpy() for n in table.column_names}
        done = c["kind"] == _REMOVED
        new = _first_of_runs(c["route"], c["anchor"], c["context"], c["kind"])
        gone = ~_repeats_first(new, c["doc"], c["mark"], c["at"]) | done
        d, m, a, b = _united(*(c[n][gone] for n in ("doc", "mark", "low", "high")))
        if len(d):
            yield _batch(_KINDS, doc=d, mark=m, low=a, high=b, kind=_REMOVED)
        firsts = np.flatnonzero(new & ~done)
        if not len(firsts):
            continue
        alike = _first_of_runs(c["route"][firsts], c["anchor"][firsts])
        size = np.diff(np.append(np.flatnonzero(alike), len(firsts)))
        frequent = c["kind"][firsts] == _FREQUENT
        enough = c["high"][firsts] - c["low"][firsts] >= WINDOW
        open_ = firsts[((np.repeat(size, size) > 1) | frequent) & enough]
        if len(open_):
            yield _batch(
                _KINDS, kind=np.where(c["kind"][open_] == _FREQUENT, _FREQUENT, _CONTEXT),
                **{n: c[n][open_] for n in ("anchor", "doc", "mark", "low", "high", "at")},
            )


_CUT = f"anchor bigint, {_DOC}, low int, at int, body binary"


def _cut_contexts(batches: Batches) -> Batches:
    """The bytes of each wanted context."""
    for batch in batches:
        out = {n: [] for n in ("anchor", "doc", "mark", "low", "at", "body")}
        rows = zip(*(batch.column(n).to_pylist() for n in ("doc", "mark")), batch.column("body"),
                   batch.column("wanted"))
        for doc, mark, body, wanted in rows:
            body = body.as_buffer()
            for want in wanted.as_py():
                out["anchor"].append(want["anchor"])
                out["doc"].append(doc)
                out["mark"].append(mark)
                out["low"].append(want["low"])
                out["at"].append(want["at"])
                out["body"].append(body[want["low"]:want["high"]].to_pybytes())
        if out["doc"]:
            yield _batch(_CUT, **out)


_RANGE = f"{_DOC}, low int, high int"


def repeats_between(doc, mark, low, bodies: list[bytes]):
    """Step 3 for one set of contexts: ranges that repeat an earlier string, by maximal repeats."""
    depth = 256
    # byte b becomes b + 1 so that 0 can close each context; 255 never occurs in UTF-8
    buffer = np.frombuffer(
        b"\x00".join([*bodies, bytes(2 * depth)]), np.uint8
    ).copy()
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    inside = np.ones(len(buffer), bool)
    inside[ends] = False
    inside[int(ends[-1]):] = False
    buffer[inside] += 1
    nodes, order = maximal_repeats(buffer, starts, ends, WINDOW, depth)
    if not len(nodes):
        return doc[:0], mark[:0], low[:0], low[:0]
    owner = np.searchsorted(starts, order, side="right") - 1
    begin = low[owner] + order - starts[owner]
    by_doc = np.lexsort((mark, doc))
    rank = np.empty(len(doc), np.int64)
    rank[by_doc] = np.cumsum(_first_of_runs(doc[by_doc], mark[by_doc]))
    age = (rank[owner] << 32) | begin
    sizes = nodes[:, 2] - nodes[:, 1] + 1
    node = np.repeat(np.arange(len(nodes)), sizes)
    place = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + nodes[node, 1]
    earliest = np.minimum.reduceat(age[place], np.cumsum(sizes) - sizes)
    later = age[place] > earliest[node]
    place, node = place[later], node[later]
    return (
        doc[owner[place]], mark[owner[place]], begin[place], begin[place] + nodes[node, 0]
    )


def _repeated(batches: Batches) -> Batches:
    """Step 3: contexts of an anchor are searched together, many anchors in one suffix array."""
    for table in _whole_groups(batches, "anchor", _SUFFIX_BYTES // (REACH + WINDOW)):
        doc, mark, low = (table.column(n).to_numpy() for n in ("doc", "mark", "low"))
        found = repeats_between(doc, mark, low.astype(np.int64), table.column("body").to_pylist())
        d, m, a, b = _united(*found)
        if len(d):
            yield _batch(_RANGE, doc=d, mark=m, low=a, high=b)


_PIECE = f"part bigint, content bigint, {_DOC}, low int, at int, least int, most int, body binary"


def _halves(batches: Batches) -> Batches:
    """The pieces of a context (or piece) whose windows end ``least`` to ``most`` bytes behind the anchor, halved.

    All windows of a piece hold its core, which is its ``part``: the ``least`` bytes behind the anchor and
    those that the furthest window has before it.
    """
    for batch in batches:
        out = {n: [] for n in ("part", "content", "doc", "mark", "low", "at", "least", "most", "body")}
        for doc, mark, low, at, least, most, body in zip(*(
            batch.column(n).to_pylist() for n in ("doc", "mark", "low", "at", "least", "most", "body")
        )):
            before, middle = at - low, (least + most) // 2
            for a, b in ((least, middle), (middle + 1, most)):
                first, last = max(a, REACH - before), min(b, len(body) - before - ANCHOR)
                if first > last:
                    continue
                start = before - REACH + first
                piece = body[start:before + ANCHOR + last]
                core = body[before - REACH + b:before + ANCHOR + a]
                for name, value in zip(out, (
                    _signed(core, a * WINDOW + b), _signed(piece, first * WINDOW + last),
                    doc, mark, low + start, at, a, b, piece,
                )):
                    out[name].append(value)
        if out["doc"]:
            yield _batch(_PIECE, **out)


def _signed(body: bytes, seed: int) -> int:
    number = xxhash.xxh64_intdigest(body, seed)
    return number - (1 << 64) if number >> 63 else number


def _divided(large: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Step 3 for anchors with many contexts: removed ranges, and pieces in groups that are small enough.

    Whoever shares a window shares the core of its piece. In each part equal pieces are settled by their
    earliest; parts that still hold many different ones are halved again, down to single windows, which are equal.
    """
    ranges, small = None, None
    left = large.withColumns({"least": F.lit(0), "most": F.lit(REACH)})
    while not left.isEmpty():
        pieces = written(left.mapInArrow(_halves, _PIECE), "pieces")
        start = F.struct("doc", "mark", "low")
        # written, so that the joins are of plain shuffles and a common piece's rows can be split
        earliest = written(pieces.groupBy("part", "content").agg(F.min(start).alias("earliest")), "first_pieces")
        several = written(earliest.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1"), "parts")
        known = pieces.join(earliest, ["part", "content"])
        later = known.filter(start > F.col("earliest")).select(
            "doc", "mark", "low", (F.col("low") + F.length("body")).alias("high")
        )
        open_ = written(
            known.filter(start == F.col("earliest")).drop("earliest").join(several, "part")
            .dropDuplicates(["part", "content"]),
            "open_pieces",
        )
        some = open_.filter(F.col("n") <= GROUP_CONTEXTS).select(
            F.col("part").alias("anchor"), "doc", "mark", "low", "body"
        )
        ranges = later if ranges is None else ranges.unionByName(later)
        small = some if small is None else small.unionByName(some)
        left = open_.filter(F.col("n") > GROUP_CONTEXTS)
    return ranges, small


def frequent_anchors(keyed: DataFrame, share: int = SAMPLE_SHARE) -> np.ndarray:
    """Anchors that many texts of a fixed sample hold; at most ``FREQUENT_AT_MOST``.

    They only decide how rows are dealt out, never what is found.
    """
    sample = keyed.filter(F.pmod(F.xxhash64("doc", "mark"), F.lit(share)) == 0)
    counts = written(
        sample.mapInArrow(_occurrences(np.empty(0, np.int64)), _OCCURRENCE)
        .filter(F.col("kind") == _SEEN).groupBy("anchor")
        .agg(F.count_distinct("doc", "mark").alias("texts")).filter(f"texts >= {FREQUENT_AT_LEAST}"),
        "frequent",
    )
    rows = counts.orderBy(F.desc("texts"), "anchor").limit(FREQUENT_AT_MOST).collect()
    return np.array([r.anchor for r in rows], np.int64)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``doc, mark, low, high``: byte ranges to remove, as ``_keyed`` names the rows."""
    keyed = _keyed(docs)
    seen = keyed.mapInArrow(_occurrences(frequent_anchors(keyed)), _OCCURRENCE)
    order = ["route", "anchor", "context", "kind", "doc", "mark", "at"]
    settled = written(
        seen.repartition("route").sortWithinPartitions(*order).mapInArrow(_settled, _KINDS),
        "settled",
    )
    wanted = settled.filter(F.col("kind") != _REMOVED).groupBy("doc", "mark").agg(
        F.collect_set(F.struct("anchor", "low", "high", "at")).alias("wanted")
    )
    cut = written(
        keyed.join(wanted, ["doc", "mark"]).select("doc", "mark", "body", "wanted")
        .mapInArrow(_cut_contexts, _CUT),
        "contexts",
    )
    many = written(
        cut.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP_CONTEXTS).select("anchor"),
        "many_contexts",
    )
    contexts_ = cut.join(many, "anchor", "left_anti").select("anchor", "doc", "mark", "low", "body")
    removed = settled.filter(F.col("kind") == _REMOVED).select("doc", "mark", "low", "high")
    ranges, pieces = _divided(cut.join(many, "anchor", "left_semi").drop("anchor"))
    if ranges is not None:
        removed, contexts_ = removed.unionByName(ranges), contexts_.unionByName(pieces)
    # by rows, not bytes: contexts are small and sorting their suffixes is not
    repeated = (
        contexts_.repartition(contexts_.count() // _TASK_CONTEXTS + 1, "anchor")
        .sortWithinPartitions("anchor").mapInArrow(_repeated, _RANGE)
    )
    return removed.unionByName(repeated)


def _with_ranges(docs: DataFrame, name: str) -> DataFrame:
    """Every row of ``docs`` with the ranges to remove as column ``name`` (null if none)."""
    doc, mark = fresh(docs, "_doc"), fresh(docs, "_mark")
    ranges = repeated_ranges(docs).groupBy("doc", "mark").agg(
        F.collect_list(F.struct("low", "high")).alias(name)
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(
        "*", F.coalesce("doc_id", F.lit(_NO_ID)).alias(doc), F.xxhash64(text).alias(mark)
    )
    named = ranges.select(F.col("doc").alias(doc), F.col("mark").alias(mark), name)
    return keyed.join(named, [doc, mark], "left").drop(doc, mark)


def removed_runs(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal removed runs of one text."""
    runs: list[list[int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in ranges or ()):
        if runs and low <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], high)
        else:
            runs.append([low, high])
    return [tuple(r) for r in runs]


def kept_bytes(body: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of a text."""
    if not runs:
        return body
    edges = [0, *(e for run in runs for e in run), len(body)]
    return b"".join([body[a:b] for a, b in zip(edges[::2], edges[1::2])])


def repeat_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs``.

    A null text counts as empty. Rows that share ``doc_id`` and text are one document and all get
    its result; rows that share only ``doc_id`` are separate documents in the order of a hash of their
    text; a null ``doc_id`` comes after all others. Extra columns are ignored; an empty table gives an
    empty result.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
        ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ])

    def task(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for doc, body, ranges in zip(*(batch.column(i) for i in range(3))):
                body = body.as_py() or b""
                runs = removed_runs(ranges.as_py())
                gone = sum(b - a for a, b in runs)
                digest = hashlib.sha256(kept_bytes(body, runs)).hexdigest()
                rows.append((doc.as_py(), len(body), gone, len(runs), digest))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema
            )

    rows = _with_ranges(docs.select("doc_id", "text"), "_ranges").select(
        "doc_id", F.col("text").cast("string").cast("binary"), "_ranges"
    )
    return rows.mapInArrow(
        task, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; a null text stays null.

    A character whose bytes are only partly removed goes with them. ``n_chars``, where there is such
    a column, is set to the new length in code points.
    """
    columns, ranges_in = docs.columns, fresh(docs, "_ranges")

    def task(batches: Batches) -> Batches:
        for batch in batches:
            texts = [
                None if body is None else
                kept_bytes(body, removed_runs(ranges)).decode("utf-8", "ignore")
                for body, ranges in zip(
                    batch.column("text").to_pylist(), batch.column(ranges_in).to_pylist()
                )
            ]
            at = batch.schema.names.index("text")
            cut = batch.set_column(at, "text", pa.array(texts, pa.string()))
            yield cut.drop_columns([ranges_in])

    rows = _with_ranges(docs, ranges_in).withColumn("text", F.col("text").cast("string").cast("binary"))
    schema = docs.withColumn("text", F.col("text").cast("string")).schema
    cut = rows.select(*columns, ranges_in).mapInArrow(task, schema)
    if "n_chars" in columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*columns)
