"""Vector tables: normalising, appending, exact top-k search, similarity features.

The search is exact. Vectors are compared block-wise with one matrix product per Arrow batch and
each batch keeps only its best ``k`` per query, so pairs are never emitted.

* A query set of checked size is shipped to the tasks; the vector table is scanned in place.
* A larger query set is cut into blocks, vectors into cells of bounded size; every (cell, block)
  tile is one co-grouped task, and the tiles' winners are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.ordering import top_per_key
from marketloom.settings import DEFAULTS
from marketloom.workspace import written

# Largest query set, in bytes of double-precision vectors, that is shipped to every task.
SHIPPED_BYTES = 32 * 1024 * 1024
# Tile sides of the search over larger query sets.
BLOCK_QUERIES = 4096
CELL_VECTORS = 65536
# Queries scored at once against one batch or cell of vectors.
SLICE_QUERIES = 256
# Vectors of an Arrow batch compared at once with the shipped queries.
_BATCH_VECTORS = 1024
# Scores are rounded before ranking, so copies of a vector tie and the lower id comes first.
SCORE_DIGITS = 9

_HITS = "query_id bigint, vec_id bigint, similarity_score double"


def normalize(vector: Column) -> Column:
    """The vector at unit length, in double precision; a zero vector stays zero.

    The sum of squares is folded once and handed to the final step, so the work per vector is
    linear in its length.
    """
    return F.aggregate(
        vector,
        F.lit(0.0),
        lambda s, x: s + x.cast("double") * x.cast("double"),
        lambda s: F.transform(
            vector, lambda x: F.coalesce(F.try_divide(x.cast("double"), F.sqrt(s)), F.lit(0.0))
        ),
    )


def build(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A search table: id, unit vector, and the other columns as metadata of the same row."""
    others = [c for c in vectors.columns if c not in (vec_id, vector)]
    return vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), normalize(F.col(vector)).alias("embedding"),
        *others,
    )


def append(index: DataFrame | None, vectors: DataFrame) -> DataFrame:
    """The search table with further vectors; an absent table is built."""
    added = build(vectors)
    return added if index is None else index.unionByName(added, allowMissingColumns=True)


def size(index: DataFrame) -> DataFrame:
    """Number of vectors."""
    return index.agg(F.count(F.lit(1)).alias("size"))


def _best(
    ids: np.ndarray, matrix: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int
) -> pd.DataFrame:
    """Best ``k`` rows of ``matrix`` per query, ties to the lower id.

    Queries are taken ``SLICE_QUERIES`` at a time, so a block of scores has at most that many rows.
    """
    parts = [
        _best_of_slice(ids, matrix, query_ids[at:at + SLICE_QUERIES], queries[at:at + SLICE_QUERIES], k)
        for at in range(0, len(query_ids), SLICE_QUERIES)
    ]
    return pd.concat(parts, ignore_index=True)


def _best_of_slice(ids, matrix, query_ids, queries, k: int) -> pd.DataFrame:
    scores = np.round(queries @ matrix.T, SCORE_DIGITS)
    k = min(k, len(ids))
    # All rows scoring at least the k-th best stay until ties are broken by id.
    floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    rows, columns = np.nonzero(scores >= floor[:, None])
    return _first_k(query_ids[rows], ids[columns], scores[rows, columns], k)


def _first_k(query_ids, ids, scores, k: int) -> pd.DataFrame:
    """The best ``k`` of many hits per query."""
    order = np.lexsort((ids, -scores, query_ids))
    query_ids, ids, scores = query_ids[order], ids[order], scores[order]
    place = np.arange(len(query_ids)) - np.searchsorted(query_ids, query_ids)
    kept = place < k
    return pd.DataFrame(
        {"query_id": query_ids[kept], "vec_id": ids[kept], "similarity_score": scores[kept]}
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _search_shipped(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Scan the vectors once with the whole (size-checked) query set in every task.

    A task keeps the best ``k`` per query over all its batches and yields them once.
    """
    rows = queries.orderBy("query_id").toPandas()
    query_ids, matrix = rows["query_id"].to_numpy(), _matrix(rows["embedding"])
    shipped = index.sparkSession.sparkContext.broadcast((query_ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shipped.value
        best = None
        for batch in batches:
            for low in range(0, batch.num_rows, _BATCH_VECTORS):
                part = batch.slice(low, _BATCH_VECTORS)
                found = _best(
                    part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1).to_pandas()),
                    ids, vectors, k,
                )
                if best is not None:
                    found = pd.concat([best, found], ignore_index=True)
                    found = _first_k(*(found[c].to_numpy() for c in found.columns), k)
                best = found
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return index.select("vec_id", "embedding").mapInArrow(run, _HITS)


def _search_tiled(index: DataFrame, queries: DataFrame, k: int, n_queries: int) -> DataFrame:
    """Every (vector cell, query block) tile is one task of bounded size."""
    n_cells = max(1, -(-index.count() // CELL_VECTORS))
    n_blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    vectors = index.select(
        "vec_id", "embedding",
        F.pmod(F.xxhash64("vec_id"), F.lit(n_cells)).alias("cell"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
    )
    asked = queries.select(
        "query_id", "embedding",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_cells - 1).cast("bigint")))
        .alias("cell"),
        F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"),
    )

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity_score": []})
        return _best(
            left["vec_id"].to_numpy(), _matrix(left["embedding"]),
            right["query_id"].to_numpy(), _matrix(right["embedding"]), k,
        )

    return vectors.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")).applyInPandas(
        tile, _HITS
    )


def search(
    index: DataFrame,
    queries: DataFrame,
    k: int = DEFAULTS.top_k_similar,
    shipped_bytes: int = SHIPPED_BYTES,
) -> DataFrame:
    """Exact top ``k`` by cosine: (query_id, rank, vec_id, similarity_score, metadata...).

    ``queries`` has query_id and embedding; rank starts at 1. An empty table gives no hits.
    """
    # Written once: the queries are measured first and used after.
    asked = written(
        queries.select(
            F.col("query_id").cast("bigint").alias("query_id"),
            normalize(F.col("embedding")).alias("embedding"),
        ),
        "queries",
    )
    measured = asked.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")
    ).first()
    if measured["n"] == 0:
        hits = index.sparkSession.createDataFrame([], _HITS)
    elif measured["n"] * measured["d"] * 8 <= shipped_bytes:
        hits = _search_shipped(index, asked, k)
    else:
        hits = _search_tiled(index, asked, k, measured["n"])
    order = [F.col("similarity_score").desc(), F.col("vec_id")]
    ranked = top_per_key(hits, ["query_id"], order, k)
    metadata = [c for c in index.columns if c not in ("vec_id", "embedding")]
    return ranked.join(index.select("vec_id", *metadata), "vec_id").select(
        "query_id", "rank", "vec_id", "similarity_score", *metadata
    )


def features(hits: DataFrame, queries: DataFrame, score: str = "sentiment_score") -> DataFrame:
    """Per query: mean similarity and mean neighbour sentiment; (0, 0) without hits."""
    known = F.coalesce(F.col(score), F.lit(0.0)) if score in hits.columns else F.lit(0.0)
    means = hits.groupBy("query_id").agg(
        F.avg("similarity_score").alias("mean_similarity"),
        F.avg(known).alias("mean_historical_sentiment"),
    )
    return queries.select("query_id").join(means, "query_id", "left").fillna(
        0.0, ["mean_similarity", "mean_historical_sentiment"]
    )


def first_hits(hits: DataFrame, limit: int = 10) -> DataFrame:
    """All hits in (query, rank) order, the first ``limit``."""
    return hits.orderBy("query_id", "rank").limit(limit)
