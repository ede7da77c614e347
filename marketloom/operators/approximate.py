"""Approximate vector search: bucket tables of signed random projections, reranked exactly.

Each table cuts the space with a few random planes; the sides a vector lies on are its bucket. A query
meets the vectors of its own bucket in every table, and of the buckets behind the planes it lies
closest to. Vectors and queries meet by an equi-join on table and bucket: a task compares the
queries of a bucket with one slice of its vectors in double precision and keeps the best k, so
pairs are never emitted and a bucket that holds a third of all vectors is many tasks. A vector that a
query meets in several tables is compared in the first of them only.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.ordering import top_per_key
from marketloom.operators.similarity import SCORE_DIGITS, SLICE_QUERIES, normalize
from marketloom.settings import DEFAULTS
from marketloom.workspace import written

#: Vectors of a bucket that one task holds.
SLICE_VECTORS = 65_536


@dataclass(frozen=True)
class Planes:
    """``tables`` sets of ``bits`` random planes; ``probes`` buckets are looked up in each table."""

    tables: int = 12
    bits: int = 12
    probes: int = 4
    seed: int = 7

    def normals(self, dimensions: int) -> np.ndarray:
        """The planes' normals, the same for the same settings."""
        rng = np.random.default_rng([self.seed, dimensions])
        return rng.normal(size=(self.tables * self.bits, dimensions))

    def sides(self, vectors: np.ndarray) -> np.ndarray:
        """Signed distances to the planes: vector, table, plane."""
        return (vectors @ self.normals(vectors.shape[1]).T).reshape(len(vectors), self.tables, self.bits)

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        return (self.sides(vectors) >= 0) @ (1 << np.arange(self.bits))

    def probed(self, vectors: np.ndarray) -> np.ndarray:
        """The buckets to look up: the own one first, then those that cross the least distance in sum."""
        sides = self.sides(vectors)
        own = (sides >= 0) @ (1 << np.arange(self.bits))
        flips = [
            f for size in range(3) for f in itertools.combinations(range(self.bits), size)
        ]
        masks = np.array([sum(1 << b for b in f) for f in flips])
        cost = np.stack([np.abs(sides[:, :, list(f)]).sum(axis=2) for f in flips], axis=2)
        chosen = np.argsort(cost, axis=2, kind="stable")[:, :, :self.probes]
        return own[:, :, None] ^ masks[chosen]


def _usable(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows whose vector is not null; a zero vector lies on no side and is left out."""
    held = [v is not None and np.any(np.asarray(v)) for v in rows["embedding"]]
    return rows[held]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _repeated(values: pd.Series, times: int) -> list:
    return [v for v in values for _ in range(times)]


def build(index: DataFrame, planes: Planes = Planes()) -> DataFrame:
    """The bucket tables of a search table (``similarity.build``): a row per vector and table, stored.

    Each row also has the vector's buckets in all tables.
    """
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in map(_usable, batches):
            if len(batch):
                buckets = planes.buckets(_matrix(batch["embedding"]))
                yield pd.DataFrame({
                    "table": np.tile(np.arange(planes.tables), len(batch)), "bucket": buckets.ravel(),
                    "vec_id": np.repeat(batch["vec_id"].to_numpy(), planes.tables),
                    "embedding": _repeated(batch["embedding"], planes.tables),
                    "buckets": _repeated(pd.Series(list(buckets)), planes.tables),
                })

    return written(index.select("vec_id", "embedding").mapInPandas(
        task, "table int, bucket long, vec_id bigint, embedding array<double>, buckets array<bigint>"
    ), "buckets")


def _asked(queries: DataFrame, planes: Planes) -> DataFrame:
    """A row per query, table and looked-up bucket, with all buckets that the query looks up."""
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in map(_usable, batches):
            if len(batch):
                buckets = planes.probed(_matrix(batch["embedding"]))
                probes = buckets.shape[2]
                each = planes.tables * probes
                yield pd.DataFrame({
                    "table": np.tile(np.repeat(np.arange(planes.tables), probes), len(batch)),
                    "bucket": buckets.ravel(), "query_id": np.repeat(batch["query_id"].to_numpy(), each),
                    "embedding": _repeated(batch["embedding"], each),
                    "probed": _repeated(pd.Series([b.ravel() for b in buckets]), each),
                })

    rows = queries.select(F.col("query_id").cast("bigint").alias("query_id"), normalize(F.col("embedding")).alias("embedding"))
    return rows.mapInPandas(
        task, "table int, bucket long, query_id bigint, embedding array<double>, probed array<bigint>"
    )


def _fresh(buckets: np.ndarray, probed: np.ndarray, table: int) -> np.ndarray:
    """Which vectors each query has not met in an earlier table: query, vector."""
    met = np.zeros((len(probed), len(buckets)), bool)
    for earlier in range(table):
        for probe in range(probed.shape[2]):
            met |= probed[:, earlier, probe][:, None] == buckets[:, earlier][None, :]
    return ~met


def _nearest(left: pd.DataFrame, right: pd.DataFrame, k: int, planes: Planes) -> pd.DataFrame:
    """The best ``k`` new vectors of a slice for each query, and how many were new."""
    order = np.argsort(left["vec_id"].to_numpy(), kind="stable")
    ids, matrix = left["vec_id"].to_numpy()[order], _matrix(left["embedding"])[order]
    buckets, table = np.stack(left["buckets"].to_list())[order], int(left["table"].iloc[0])
    parts = []
    for at in range(0, len(right), SLICE_QUERIES):
        some = right.iloc[at:at + SLICE_QUERIES]
        probed = np.stack(some["probed"].to_list()).reshape(len(some), planes.tables, -1)
        fresh = _fresh(buckets, probed, table)
        scores = np.where(fresh, np.round(_matrix(some["embedding"]) @ matrix.T, SCORE_DIGITS), -np.inf)
        # ids rise along a row, so a stable sort leaves ties to the lower id
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(scores, best, axis=1)
        row, column = np.nonzero(value > -np.inf)
        parts.append(pd.DataFrame({
            "query_id": some["query_id"].to_numpy()[row], "vec_id": ids[best[row, column]],
            "similarity_score": value[row, column], "here": np.where(column == 0, fresh.sum(axis=1)[row], 0),
        }))
    return pd.concat(parts, ignore_index=True)


def search(
    buckets: DataFrame, queries: DataFrame, k: int = DEFAULTS.top_k_similar, planes: Planes = Planes(),
    slice_vectors: int = SLICE_VECTORS,
) -> DataFrame:
    """``query_id, rank, vec_id, similarity_score, met`` of the best ``k`` vectors each query meets.

    Scores are exact cosines, ties go to the lower id; ids are unique. ``met`` is how many vectors the
    query was compared with. Null and zero vectors, as queries or
    as vectors, meet nothing. ``planes`` must be those the buckets were built with.
    """
    asked = written(_asked(queries, planes), "asked")
    key = ["table", "bucket"]
    wanted = buckets.join(asked.select(*key).distinct(), key, "left_semi")
    slices = written(
        wanted.groupBy(*key).agg(F.ceil(F.count("*") / slice_vectors).alias("slices")), "slices"
    )
    vectors = wanted.join(slices, key).withColumn("slice", F.pmod(F.xxhash64("vec_id"), "slices"))
    parts = slices.select(F.col("table").alias("of_table"), F.col("bucket").alias("of_bucket"), F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)
    ).alias("of_slice"))
    questions = asked.join(parts, (F.col("table") == F.col("of_table")) & (F.col("bucket") == F.col("of_bucket")))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity_score": [], "here": []})
        return _nearest(left, right, k, planes)

    hits = written(vectors.groupBy(*key, "slice").cogroup(questions.groupBy("of_table", "of_bucket", "of_slice")).applyInPandas(
        meet, "query_id bigint, vec_id bigint, similarity_score double, here bigint"
    ), "hits")
    met = hits.groupBy("query_id").agg(F.sum("here").alias("met"))
    order = [F.col("similarity_score").desc(), F.col("vec_id")]
    ranked = top_per_key(hits.drop("here"), ["query_id"], order, k)
    return ranked.join(met, "query_id").select("query_id", "rank", "vec_id", "similarity_score", "met")


def quality(found: DataFrame, exact: DataFrame, index: DataFrame) -> DataFrame:
    """``queries, recall, met_share``: the share of the exact hits found, and of the table compared per query."""
    got = found.select("query_id", "vec_id", F.lit(1).alias("got"))
    asked = exact.select("query_id", "vec_id").join(got, ["query_id", "vec_id"], "left").select(
        "query_id", F.lit(1).alias("hits"), F.coalesce("got", F.lit(0)).alias("got"), F.lit(0).alias("met"), F.lit(0).alias("rows")
    )
    none = F.lit(None).cast("bigint").alias("query_id")
    met = found.groupBy("query_id").agg(F.max("met").alias("met")).select(none, F.lit(0), F.lit(0), "met", F.lit(0))
    rows = index.select(none, F.lit(0), F.lit(0), F.lit(0), F.lit(1))
    total = asked.union(met).union(rows).agg(
        F.countDistinct("query_id").alias("queries"), *[F.sum(c).alias(c) for c in ("hits", "got", "met", "rows")]
    )
    return total.select(
        "queries", F.try_divide("got", "hits").alias("recall"),
        F.try_divide(F.try_divide("met", "queries"), F.col("rows")).alias("met_share"),
    )
