"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are fitted on a bounded sample; every row is then sent down each tree to its leaf. A
query walks all trees at once: one priority queue holds the branches not taken, by how far the query
lies on the wrong side, and the nearest leaves of the whole forest are opened until their expected
rows reach a budget. Candidates are ranked by their exact distance where the leaf lies, and the
best of all leaves are merged.

A leaf is dealt out in slices of bounded size, and equal vectors are one candidate that carries as
many ids as a result can use, so no leaf or group of copies becomes one task's burden.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.vectors import matrix, usable
from marketloom.workspace import written

TREES = 4
SAMPLE_ROWS = 16384
LEAF_ROWS = 128
SHARE_OF_SAMPLE = 1.4
SLICE_ROWS = 4096
NEIGHBOURS = 10


class Tree:
    """One tree: inner nodes split by a direction and an offset, leaves by number."""

    def __init__(self, rows: np.ndarray, leaf_rows: int, seed: int) -> None:
        random = np.random.default_rng(seed)
        self.directions, self.offsets, self.children, self.sizes = [], [], [], []

        def grow(part: np.ndarray) -> int:
            if len(part) > leaf_rows:
                for _ in range(5):
                    a, b = part[random.choice(len(part), 2, replace=False)]
                    direction = a - b
                    norm = np.sqrt(direction @ direction)
                    if not norm:
                        continue
                    direction /= norm
                    side = part @ direction
                    offset = float(np.median(side))
                    right = side > offset
                    if 0 < right.sum() < len(part):
                        at = len(self.offsets)
                        self.directions.append(direction)
                        self.offsets.append(offset)
                        self.children.append([0, 0])
                        self.children[at] = [grow(part[~right]), grow(part[right])]
                        return at
            self.sizes.append(len(part))
            return -len(self.sizes)

        self.root = grow(rows)
        self.matrix = np.array(self.directions) if self.directions else np.zeros((0, rows.shape[1]))
        self.offsets, self.children = np.array(self.offsets), np.array(self.children).reshape(-1, 2)

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        at = np.full(len(rows), self.root)
        inner = np.flatnonzero(at >= 0)
        while len(inner):
            node = at[inner]
            side = np.einsum("ij,ij->i", rows[inner], self.matrix[node]) > self.offsets[node]
            at[inner] = self.children[node, side.astype(int)]
            inner = inner[at[inner] >= 0]
        return -at - 1


def grow_forest(rows: np.ndarray, trees: int, leaf_rows: int) -> list[Tree]:
    """Trees over a sample; the same sample gives the same trees."""
    return [Tree(rows, leaf_rows, seed) for seed in range(trees)]


def nearest_leaves(forest: list[Tree], query: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """``(tree, leaf)`` in order of the queue until the opened leaves hold ``budget`` sample rows."""
    sides = [tree.matrix @ query - tree.offsets for tree in forest]
    queue = [(0.0, number, tree.root) for number, tree in enumerate(forest)]
    heapq.heapify(queue)
    opened, held = [], 0
    while queue and held < budget:
        missed, number, at = heapq.heappop(queue)
        tree, side = forest[number], sides[number]
        while at >= 0:
            margin = side[at]
            near, far = tree.children[at][[int(margin > 0), int(margin <= 0)]]
            heapq.heappush(queue, (max(missed, abs(float(margin))), number, int(far)))
            at = int(near)
        opened.append((number, -at - 1))
        held += tree.sizes[-at - 1]
    return opened


_VECTOR = "array<double>"


def search(
    vectors: DataFrame, is_query: Column, neighbours: int = NEIGHBOURS, trees: int = TREES,
    sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, share: float = SHARE_OF_SAMPLE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows found for each query row.

    ``share`` is the share of the sample, counted over all trees, that a query's leaves hold. Rows whose
    vector is null, zero or has a null or non-finite component, and rows with a null ``vec_id``, take
    no part. Vectors of different length are not compared. Rows that share ``vec_id`` are one row as
    a query (the least vector counts) and never their own neighbour; as candidates they are one
    id, at its least distance. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(
        "vec_id", F.col("embedding").cast(_VECTOR).alias("vector"), is_query.alias("asks")
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    slot = Window.partitionBy("vector").orderBy("vec_id")
    nodes = written(
        rows.select("vec_id", "vector").distinct()
        .withColumn("_n", F.row_number().over(slot)).filter(F.col("_n") <= neighbours + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "vectors",
    )
    queries = rows.filter("asks").groupBy("vec_id").agg(F.min("vector").alias("vector"))

    sample = nodes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample_rows)
    by_size: dict[int, list] = {}
    for row in sample.toPandas()["vector"]:
        by_size.setdefault(len(row), []).append(row)
    forests = {
        size: grow_forest(np.array(part), trees, leaf_rows) for size, part in by_size.items()
    }
    budget = {size: max(1, int(share * len(part))) for size, part in by_size.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(0).value_lengths().to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                values = matrix(part.column(0))
                for number, tree in enumerate(forests.get(int(size), [None])):
                    leaf = np.zeros(len(values), np.int64) if tree is None else tree.leaves(values)
                    key = leaf * 256 + number
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), size, np.int32)), pa.array(key),
                         part.column(1), part.column(0)],
                        ["size", "leaf", "ids", "vector"],
                    )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"size": [], "leaf": [], "vec_id": [], "vector": []}
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = len(vector)
                opened = [(0, 0)]
                if size in forests:
                    opened = nearest_leaves(forests[size], np.array(vector), budget[size])
                for number, leaf in opened:
                    out["size"].append(size)
                    out["leaf"].append(leaf * 256 + number)
                    out["vec_id"].append(vec_id)
                    out["vector"].append(vector)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out.values(), types)], list(out)
            )

    def rank(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            values = np.stack(right["vector"].to_numpy())
            ids = right["ids"].to_numpy()
            for query, vector in zip(left["vec_id"], left["vector"]):
                gap = values - vector
                score = np.sqrt((gap * gap).sum(axis=1))
                most = min(neighbours + 1, len(score)) - 1
                near = np.flatnonzero(score <= np.partition(score, most)[most])
                pairs = sorted(
                    (score[i], v) for i in near for v in ids[i] if v != query
                )[:neighbours]
                found += [(query, v, s) for s, v in pairs]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )

    placed = written(
        nodes.select("vector", "ids").mapInArrow(
            place, f"size int, leaf bigint, ids array<bigint>, vector {_VECTOR}"
        ),
        "leaves",
    )
    slices = written(
        placed.groupBy("size", "leaf").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).alias("slices")),
        "slices",
    )
    here = placed.join(slices, ["size", "leaf"]).select(
        "size", "leaf", F.pmod(F.xxhash64("vector"), "slices").alias("slice"), "ids", "vector"
    )
    wanted = slices.select(
        F.col("size").alias("of_size"), F.col("leaf").alias("of_leaf"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"),
    )
    asked = queries.mapInArrow(
        probe, f"size int, leaf bigint, vec_id bigint, vector {_VECTOR}"
    ).join(wanted, (F.col("size") == F.col("of_size")) & (F.col("leaf") == F.col("of_leaf"))).select(
        F.col("size").alias("a_size"), F.col("leaf").alias("a_leaf"),
        F.col("slice").alias("a_slice"), "vec_id", "vector",
    )
    found = asked.groupBy("a_size", "a_leaf", "a_slice").cogroup(
        here.groupBy("size", "leaf", "slice")
    ).applyInPandas(rank, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= neighbours)
        .select("query_id", "rank", "vec_id", "score")
    )
