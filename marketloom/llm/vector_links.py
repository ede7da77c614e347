"""Near-duplicate vectors by int8 tile products with error bounds.

Unit vectors ``x`` are stored as ``s * q + e`` with int8 ``q``. For two of them
``x.y = (s q).(t r) + e.(t r) + x.f``, so ``|x.y - st q.r| <= |e| |t r| + |f|``: an int8 product
tells rigorously which pairs may reach the threshold, and only those are computed in doubles.

Equal vectors of a label are one node with a count. Nodes are cut into blocks along the angle to a
few fixed directions; two blocks whose angles lie further apart than a link allows never meet.
A tile (two blocks) yields one row per node, its links and a link to its tile component, so a
group of near copies costs its size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.components import labelled, roots
from marketloom.llm.vectors import matrix, unit, usable
from marketloom.workspace import written

BLOCK_BYTES = 1 << 19
DIRECTIONS = 8
_EXACT_PAIRS = 1 << 14
_SLACK = 1e-9


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``q`` (int8), its scale, the length of what was lost, and the length of what is kept."""
    scale = np.abs(rows).max(axis=1) / 127
    q = np.rint(rows / scale[:, None]).astype(np.int8)
    kept = q * scale[:, None]
    lost = np.sqrt(((rows - kept) ** 2).sum(axis=1))
    return q, scale, lost, np.sqrt((kept * kept).sum(axis=1))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows; floats hold them exactly as long as they fit."""
    kind = np.float32 if left.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return left.astype(kind) @ right.astype(kind).T


def links_in_tile(
    left: np.ndarray, right: np.ndarray, threshold: float, same: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``(i, j)`` of linked unit rows; each pair once if both sides are one block."""
    q, s, e, _ = quantised(left)
    r, t, f, kept = quantised(right)
    near = products(q, r) * (s[:, None] * t) + e[:, None] * kept + f >= threshold - _SLACK
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    exact = np.empty(len(i), bool)
    for low in range(0, len(i), _EXACT_PAIRS):
        part = slice(low, low + _EXACT_PAIRS)
        exact[part] = (left[i[part]] * right[j[part]]).sum(axis=1) >= threshold
    return i[exact], j[exact]


def directions(size: int, count: int = DIRECTIONS) -> np.ndarray:
    """Fixed unit directions for vectors of ``size`` components."""
    return unit(np.random.default_rng(size).normal(size=(count, size)))


_NODE = "node bigint, space string, angle double, copies bigint, vector array<double>"
_BLOCK = (
    "block string, space string, low array<double>, high array<double>, "
    "nodes array<bigint>, copies array<bigint>, vectors array<double>"
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive nodes of one space, in order of their first angle, as one row a block."""
    from pyspark import TaskContext

    part, number, held = TaskContext.get().partitionId(), 0, None

    def block(table: pa.Table) -> pa.RecordBatch:
        nonlocal number
        number += 1
        rows = matrix(table.column("vector").combine_chunks())
        angles = np.arccos(np.clip(rows @ directions(rows.shape[1]).T, -1, 1))
        return pa.RecordBatch.from_pydict({
            "block": [f"{part}-{number}"], "space": table.column("space")[:1].combine_chunks(),
            "low": [angles.min(axis=0)], "high": [angles.max(axis=0)],
            "nodes": [table.column("node").to_numpy()],
            "copies": [table.column("copies").to_numpy()], "vectors": [rows.ravel()],
        })

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        while held.num_rows:
            space = held.column("space")
            other = pc.index(pc.not_equal(space, space[0]), True).as_py()
            end = held.num_rows if other < 0 else other
            most = max(64, BLOCK_BYTES // (8 * len(held.column("vector")[0])))
            if end == held.num_rows and end < most:
                break
            yield block(held.slice(0, min(end, most)))
            held = held.slice(min(end, most))
    if held is not None and held.num_rows:
        yield block(held)


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors, their space (label and length) and their angle to the first direction."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(2).value_lengths().to_numpy()
        for size in np.unique(sizes):
            part = batch.filter(pa.array(sizes == size))
            rows = unit(matrix(part.column(2)))
            angle = np.arccos(np.clip(rows @ directions(int(size))[0], -1, 1))
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(len(rows) + 1, dtype=np.int32) * int(size)), pa.array(rows.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(angle), part.column(3), flat],
                ["node", "space", "angle", "copies", "vector"],
            )


def _tiles(threshold: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                value = {
                    n: batch.column(n)[row].values.to_numpy() for n in
                    ("nodes", "copies", "vectors", "nodes2", "copies2", "vectors2")
                }
                same = batch.column("block")[row] == batch.column("block2")[row]
                left = value["vectors"].reshape(len(value["nodes"]), -1)
                right = value["vectors2"].reshape(len(value["nodes2"]), -1)
                i, j = links_in_tile(left, right, threshold, same)
                shift = 0 if same else len(left)
                nodes = value["nodes"] if same else np.concatenate([value["nodes"], value["nodes2"]])
                links = np.zeros(len(nodes), np.int64)
                np.add.at(links, i, value["copies2"][j])
                np.add.at(links, j + shift, value["copies"][i])
                root = roots(np.arange(len(nodes)), i, j + shift)
                linked = links > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[linked]), pa.array(links[linked]),
                     pa.array(nodes[root[linked]])],
                    ["node", "links", "other"],
                )

    return task


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Compared are rows of equal, non-null ``label`` (of any type that has a text form) and equal length by
    cosine in doubles. A row that
    takes no part (null label; vector null, zero or with a null or non-finite component) has no links
    and is its own component. Repeated rows count as other vectors. A row with a null ``vec_id`` links
    but names no component and is not kept. Extra columns are ignored; an empty table gives an empty
    result.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(
        "vec_id", "label", vector.alias("vector"),
        (usable(vector) & F.col("label").isNotNull()).alias("usable"),
    )
    nodes = written(
        rows.filter("usable").groupBy("label", "vector")
        .agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    space = F.concat_ws(":", F.size("vector"), F.col("label").cast("string")).alias("space")
    angles = nodes.select("node", space, "vector", "copies").mapInArrow(_angles, _NODE)
    blocks = written(
        angles.repartitionByRange("space", "angle").sortWithinPartitions("space", "angle")
        .mapInArrow(_blocks, _BLOCK),
        "blocks",
    )
    reach = float(np.arccos(threshold)) + 1e-6
    ends = blocks.select("block", "space", "low", "high")
    others = ends.select(*[F.col(c).alias(f"{c}2") for c in ends.columns])
    apart = F.exists(
        F.arrays_zip("low", "high", "low2", "high2"),
        lambda z: (z["low2"] > z["high"] + reach) | (z["low"] > z["high2"] + reach),
    )
    tiles = (
        ends.join(others, F.col("space") == F.col("space2"))
        .filter((F.col("block") <= F.col("block2")) & ~apart).select("block", "block2")
    )
    body = blocks.select("block", "nodes", "copies", "vectors")
    second = body.select(*[F.col(c).alias(f"{c}2") for c in body.columns])
    found = written(
        tiles.repartition("block", "block2").join(body, "block").join(second, "block2")
        .mapInArrow(_tiles(threshold), "node bigint, links bigint, other bigint"),
        "links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = nodes.select("node", "label", "vector", "least_id", "copies").join(
        labelled(found.select("node", "other")), "node", "left"
    ).join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_node = rooted.join(names, "root").select(
        "label", "vector", "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    taking_part = rows.filter("usable").join(of_node, ["label", "vector"]).select(
        "vec_id", "n_links", "component_id"
    )
    apart_rows = rows.filter("not usable").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return taking_part.unionByName(apart_rows).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
