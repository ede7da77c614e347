"""Bucket tables of random projections against a comparison of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import approximate as ap
from marketloom.operators import similarity as sm

PLANES = ap.Planes(tables=6, bits=5, probes=3, seed=3)
SCHEMA = "vec_id bigint, embedding array<double>"


@pytest.fixture(scope="module")
def vectors():
    """Thirty clusters, a third of all vectors copies of one, a zero and a null vector."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(30, 12))
    rows = [(i, (centres[i % 30] + 0.2 * rng.normal(size=12)).tolist()) for i in range(240)]
    rows += [(1000 + i, centres[4].tolist()) for i in range(120)]
    return [*rows, (5000, [0.0] * 12), (5001, None)], centres


def brute(rows, queries, k):
    """What each query meets in any table, and the best of it."""
    held = [(i, np.array(v)) for i, v in rows if v is not None and np.any(v)]
    ids = np.array([i for i, _ in held])
    unit = np.stack([v / np.linalg.norm(v) for _, v in held])
    buckets, out = PLANES.buckets(unit), {}
    for q, v in queries:
        v = np.array(v) / np.linalg.norm(v)
        probed = PLANES.probed(v[None])[0]
        met = np.array([any(b[t] in probed[t] for t in range(PLANES.tables)) for b in buckets])
        scores = np.round(unit @ v, 9)
        best = sorted((-scores[i], ids[i]) for i in np.flatnonzero(met))[:k]
        out[q] = (int(met.sum()), [int(i) for _, i in best])
    return out


@pytest.mark.parametrize("slice_vectors", [7, 100_000])
def test_hits_are_the_best_of_what_is_met(spark, vectors, slice_vectors):
    rows, centres = vectors
    queries = [(i, c.tolist()) for i, c in enumerate(centres[:12])]
    index = sm.build(spark.createDataFrame(rows, SCHEMA).repartition(3))
    asked = spark.createDataFrame([*queries, (99, None), (98, [0.0] * 12)], "query_id bigint, embedding array<double>")
    found = ap.search(ap.build(index, PLANES), asked, 8, PLANES, slice_vectors).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], (r["met"], []))[1].append(r["vec_id"])
    assert got == brute(rows, queries, 8)


def test_recall_on_clusters(spark, vectors):
    rows, centres = vectors
    index = sm.build(spark.createDataFrame(rows, SCHEMA)).filter("vec_id < 5000").cache()
    asked = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "query_id bigint, embedding array<double>")
    planes = ap.Planes(tables=10, bits=8, probes=4)
    found = ap.search(ap.build(index, planes), asked, 5, planes)
    told = ap.quality(found, sm.search(index, asked, 5), index).first()
    assert told["queries"] == 30 and told["recall"] >= 0.9


def test_nothing_to_search(spark, vectors):
    rows, centres = vectors
    empty = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(0, centres[0].tolist())], "query_id bigint, embedding array<double>")
    assert ap.search(ap.build(sm.build(empty)), asked).count() == 0
    some = sm.build(spark.createDataFrame(rows[:5], SCHEMA))
    assert ap.search(ap.build(some), asked.limit(0)).count() == 0
    assert ap.search(ap.build(some), asked.withColumn("embedding", F.lit(None).cast("array<double>"))).count() == 0


@pytest.mark.parametrize("name", ["d4_approximate_search", "d4_search_quality"])
def test_registered_queries_equal_their_sql(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as entry_module
    from tools.check_oracle import compare

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=32).tolist(), i % 10) for i in range(1000)]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    note, good = compare(
        spark, con, str(tmp_path), name, entry_module.queries()[name], entry_module.oracle_sql()[name]
    )
    assert good, note
