"""Connected components, distributed and inside one task.

``roots`` contracts the links one task has found; ``labelled`` joins such contractions from all
tasks with alternating star steps. Neither ever holds the links of the whole corpus in one place.
The least neighbours are written before they are joined, so both sides of that join are plain
shuffles and adaptive execution can split a node that half the corpus hangs on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.workspace import written


def roots(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Merge the links ``left[i] - right[i]`` into ``parent``; every entry then names its root.

    ``parent`` must be flat (each entry a root) on entry, ``np.arange(n)`` at first. The root of
    a component is its smallest index.
    """
    while len(left):
        a, b = parent[left], parent[right]
        open_ = a != b
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        if not len(left):
            break
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _smaller_neighbours_to_least(links: DataFrame) -> DataFrame:
    """Small star: a node and its smaller neighbours all point to the least of them."""
    least = written(links.groupBy("node").agg(F.min("other").alias("least")), "least")
    moved = links.join(least, "node").select(
        F.col("other").alias("node"), F.col("least").alias("other")
    )
    own = least.select("node", F.col("least").alias("other"))
    return moved.unionByName(own).filter("node > other").distinct()


def _larger_neighbours_to_least(links: DataFrame) -> DataFrame:
    """Large star: the larger neighbours of a node point to the least node around it."""
    both = links.unionByName(
        links.select(F.col("other").alias("node"), F.col("node").alias("other"))
    )
    least = written(
        both.groupBy("node").agg(F.min("other").alias("least"))
        .select("node", F.least("node", "least").alias("least")),
        "least",
    )
    return (
        both.filter("other > node").join(least, "node")
        .select(F.col("other").alias("node"), F.col("least").alias("other"))
        .filter("node > other").distinct()
    )


def labelled(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (two bigint columns) but the roots themselves.

    ``root`` is the least node reachable. Rows with a null and links of a node to itself say
    nothing and are ignored. Each round is written to the shared folder; the rounds grow with the
    logarithm of the longest path.
    """
    a, b = (F.col(c) for c in links.columns)
    stars = written(
        links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other"))
        .filter(a.isNotNull() & b.isNotNull() & (a != b)).distinct(),
        "links",
    )
    while True:
        unfinished = stars.join(
            stars.select(F.col("node").alias("other")).distinct(), "other", "left_semi"
        ).union(
            stars.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        )
        if unfinished.isEmpty():
            return stars.select("node", F.col("other").alias("root"))
        stars = written(
            _smaller_neighbours_to_least(_larger_neighbours_to_least(stars)), "links"
        )
