"""SimHash near-duplicates, found by vantage-point trees over the fingerprints.

A link is a pair of fingerprints that differ in at most ``radius`` bits. The 64 bits are cut into
``radius // 2 + 1`` masks; two linked fingerprints differ in at most one bit under some mask
(two linked texts cannot spend more than ``radius`` bits). Each mask has its own vantage-point
tree over the distance *under that mask*, which is a metric:

* inner nodes hold a vantage point and a distance ``split``; points at most ``split`` away go
  near, the others far;
* by the triangle inequality a link changes the distance by at most the masked radius, so only
  near points in the last shell (``distance > split - masked radius``) can have a partner on the far
  side. They are copied there, so each pair stays together in at least one child, and every other
  pair of branches is pruned;
* the upper levels, fitted on a bounded sample, cut the fingerprints into shards; a task grows the
  rest of the tree inside its shard and compares whole fingerprints in the leaves.

Equal fingerprints are one node from the start, so groups of copies never meet pairwise.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.components import labelled, roots
from marketloom.workspace import written

BITS = 64
SHARD_POINTS = 16384
SAMPLE_POINTS = 8192
LEAF_POINTS = 48
_BLOCK = 1 << 16
_PENDING = 1 << 18


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The SimHash of one whole text; 0 for a text without words or null."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    span = min(words, len(parts))
    count = len(parts) - span + 1
    starts, ends = starts[:count], ends[span - 1:]
    set_bits = np.zeros(BITS, np.int64)
    for low in range(0, count, _BLOCK):
        cuts = map(slice, starts[low:low + _BLOCK].tolist(), ends[low:low + _BLOCK].tolist())
        hashes = np.fromiter(
            map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), itertools.repeat(seed)),
            "<u8", min(_BLOCK, count - low),
        )
        set_bits += np.unpackbits(
            hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        ).sum(0, dtype=np.int64)
    majority = np.packbits(2 * set_bits > count, bitorder="little")
    return int(majority.view("<u8")[0])


def with_fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id`` and the fingerprint as a signed long (``code``) of every row."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter(
                (fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(codes.view(np.int64))], ["doc_id", "code"]
            )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        task, "doc_id bigint, code bigint"
    )


def masks_for(radius: int) -> tuple[list[int], int]:
    """Disjoint masks that cover all bits, and the radius two links keep under one of them."""
    count = radius // 2 + 1
    edges = [BITS * i // count for i in range(count + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])], radius // count


def _distance(codes: np.ndarray, other, mask) -> np.ndarray:
    return np.bitwise_count((codes ^ other) & mask).astype(np.int16)


def choose_vantage(codes: np.ndarray, mask: np.uint64, radius: int, tries: int = 6):
    """A vantage point and split whose larger child is smallest; None if nothing splits."""
    best, limit = None, 0.95 * len(codes)
    for at in np.linspace(0, len(codes) - 1, tries).astype(int):
        for point in (codes[at], ~codes[at]):
            counts = np.bincount(_distance(codes, point, mask), minlength=BITS + 1)
            near = np.cumsum(counts)
            before = np.concatenate([np.zeros(radius, np.int64), near])[: len(near)]
            far = len(codes) - before
            sizes = np.maximum(near, far)
            split = int(np.argmin(sizes))
            if sizes[split] < limit:
                best, limit = (point, split), sizes[split]
    return best


def divided(codes: np.ndarray, point, split: int, mask, radius: int):
    """Positions for the near and for the far child; the boundary shell goes to both."""
    distance = _distance(codes, point, mask)
    return np.flatnonzero(distance <= split), np.flatnonzero(distance > split - radius)


def fit_tree(sample: np.ndarray, mask: int, radius: int, depth: int) -> dict:
    """The upper levels: heap position -> (vantage point, split), down to ``depth``."""
    tree, waiting = {}, [(1, sample)]
    while waiting:
        at, codes = waiting.pop()
        if at >= 1 << depth or len(codes) < 4:
            continue
        vantage = choose_vantage(codes, np.uint64(mask), radius)
        if vantage is None:
            continue
        tree[at] = vantage
        for child, rows in zip((2 * at, 2 * at + 1), divided(codes, *vantage, np.uint64(mask), radius)):
            waiting.append((child, codes[rows]))
    return tree


def shards_of(codes: np.ndarray, tree: dict, mask: int, radius: int):
    """``(position, shard)`` arrays: every shard a fingerprint belongs to, its boundary copies too."""
    found, waiting = [], [(1, np.arange(len(codes)))]
    while waiting:
        at, rows = waiting.pop()
        if not len(rows):
            continue
        if at not in tree:
            found.append((rows, np.full(len(rows), at, np.int64)))
            continue
        near, far = divided(codes[rows], *tree[at], np.uint64(mask), radius)
        waiting += [(2 * at, rows[near]), (2 * at + 1, rows[far])]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([r for r, _ in found]), np.concatenate([s for _, s in found])


def linked_in_shard(codes: np.ndarray, mask: int, masked_radius: int, radius: int) -> np.ndarray:
    """Root position of each fingerprint after linking all pairs of the shard within ``radius``."""
    mask = np.uint64(mask)
    parent = np.arange(len(codes))
    left, right, held = [], [], 0
    waiting = [np.arange(len(codes))]
    while waiting:
        rows = waiting.pop()
        vantage = None
        if len(rows) > LEAF_POINTS:
            vantage = choose_vantage(codes[rows], mask, masked_radius, 2)
            if vantage is None:
                vantage = choose_vantage(codes[rows], mask, masked_radius, 12)
        if vantage is not None:
            near, far = divided(codes[rows], *vantage, mask, masked_radius)
            waiting += [rows[near], rows[far]]
            continue
        for low in range(0, len(rows), 512):
            block = rows[low:low + 512]
            for other_low in range(low, len(rows), 4096):
                others = rows[other_low:other_low + 4096]
                close = np.bitwise_count(codes[block][:, None] ^ codes[others][None, :]) <= radius
                i, j = np.nonzero(close)
                different = block[i] != others[j]
                left.append(block[i][different])
                right.append(others[j][different])
                held += len(left[-1])
                if held > _PENDING:
                    parent = roots(parent, np.concatenate(left), np.concatenate(right))
                    left, right, held = [], [], 0
    if held:
        parent = roots(parent, np.concatenate(left), np.concatenate(right))
    return parent


def fingerprint_links(
    nodes: DataFrame, radius: int = 4, shard_points: int = SHARD_POINTS,
    sample_points: int = SAMPLE_POINTS,
) -> DataFrame:
    """Links ``(a, b)`` that connect distinct ``code`` values within ``radius``, as forests.

    ``nodes`` must be a stable (written) table of distinct codes. A shard yields at most one link
    per fingerprint it holds, however many pairs lie in it. The trees' upper levels come from at
    most ``sample_points`` fingerprints; any sample gives the same links.
    """
    spark = nodes.sparkSession
    masks, masked_radius = masks_for(radius)
    total = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, total / shard_points)))))
    sample = np.array([], np.int64)
    if depth:
        rows = nodes.orderBy(F.xxhash64("code"), "code").limit(sample_points).collect()
        sample = np.array([r.code for r in rows], np.int64)
    trees = [fit_tree(sample.view(np.uint64), m, masked_radius, depth) for m in masks]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False)
            for number, (mask, tree) in enumerate(zip(masks, trees)):
                rows, shards = shards_of(codes.view(np.uint64), tree, mask, masked_radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), number, np.int32)), pa.array(shards),
                     pa.array(codes[rows])],
                    ["mask", "shard", "code"],
                )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = np.sort(pdf["code"].to_numpy())
        parent = linked_in_shard(
            codes.view(np.uint64), masks[int(pdf["mask"].iloc[0])], masked_radius, radius
        )
        child = np.flatnonzero(parent != np.arange(len(codes)))
        return pd.DataFrame({"a": codes[child], "b": codes[parent[child]]})

    routed = nodes.select("code").mapInArrow(route, "mask int, shard bigint, code bigint")
    return routed.groupBy("mask", "shard").applyInPandas(search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most ``radius`` bits.
    Null and empty texts have fingerprint zero, which links like any other. A row with a null
    ``doc_id`` keeps its row; it joins its component but never names it (null if the component
    has no other). Repeated rows stay repeated. Extra columns are ignored; an empty table gives
    an empty result.
    """
    prints = written(with_fingerprints(docs, words), "fingerprints")
    nodes = written(prints.groupBy("code").agg(F.min("doc_id").alias("least_id")), "nodes")
    linked = labelled(fingerprint_links(nodes, radius))
    rooted = nodes.join(
        linked.withColumnRenamed("node", "code"), "code", "left"
    ).select("code", "least_id", F.coalesce("root", "code").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_code = rooted.join(names, "root").select("code", "component_id")
    return prints.join(of_code, "code").select(
        "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id"
    )
