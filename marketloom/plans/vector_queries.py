"""Registered queries over vectors: search by centroid and by headline text."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from marketloom.operators import embedding as em
from marketloom.operators import approximate as ap
from marketloom.operators import similarity as sm
from marketloom.operators.serving import TextIndex
from marketloom.plans.price_queries import rounded
from marketloom.plans.registry import query
from marketloom.plans.sentiment_queries import SCORED_SQL, scored
from marketloom.workspace import new_path, written
from marketloom.plans.tables import headlines, table
from marketloom.plans.text_queries import strip_sql, _lit
from marketloom.functions.text import SPACES_PATTERN
from marketloom.settings import DEFAULTS

DIM = DEFAULTS.embedding_dim

_UNIT = (
    "list_transform({v}, lambda x: coalesce(CAST(x AS DOUBLE) / nullif(sqrt(list_sum("
    "list_transform({v}, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 0), 0.0e0))"
)


def unit_sql(v: str) -> str:
    return _UNIT.format(v=v)


# Every third vector is stretched: normalising must undo it.
_STRETCHED_SQL = """
stretched AS (SELECT vec_id, label, CASE WHEN label % 3 = 0 THEN
  list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) ELSE
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS embedding FROM embeddings)"""

INDEX_SQL = _STRETCHED_SQL + f""",
vectors AS MATERIALIZED (SELECT vec_id, label, {unit_sql('embedding')} AS v FROM stretched),
cells AS (SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v,
          unnest(range(1, len(v) + 1)) AS i FROM vectors) GROUP BY ALL),
asked AS MATERIALIZED (SELECT query_id, {unit_sql('c')} AS q FROM (
  SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY i) AS c FROM cells GROUP BY label)),
scores AS (SELECT query_id, vec_id, label,
           round(list_dot_product(q, v), 9) AS s FROM asked CROSS JOIN vectors),
hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
         ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM scores) WHERE rank <= 5)"""


def stretched(spark, sf_dir):
    """The vector table with a third of the labels at three times unit length."""
    factor = F.when(F.col("label") % 3 == 0, 3.0).otherwise(1.0)
    return table(spark, sf_dir, "embeddings").withColumn(
        "embedding", F.transform("embedding", lambda x: x.cast("double") * factor)
    )


def vector_index(spark, sf_dir):
    return sm.build(stretched(spark, sf_dir))


def centroids(index):
    """One query per label: the mean vector, in one aggregate over whole vectors."""
    means = index.select("label", array_to_vector("embedding").alias("v")).groupBy("label").agg(
        Summarizer.mean(F.col("v")).alias("c")
    )
    return means.select(
        F.col("label").cast("bigint").alias("query_id"), vector_to_array("c").alias("embedding")
    )


@query(
    "d1_normalize",
    f"WITH {_STRETCHED_SQL} SELECT vec_id, label, round(list_dot_product(v, v), 6) AS norm, "
    f"round(v[1], 6) AS first_entry FROM (SELECT *, {unit_sql('embedding')} AS v FROM stretched)",
)
def d1(spark, sf_dir):
    v = F.col("embedding")
    return vector_index(spark, sf_dir).select(
        "vec_id", "label",
        F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"),
        F.round(v[0], 6).alias("first_entry"),
    )


@query(
    "d2_append",
    f"WITH {_STRETCHED_SQL} SELECT vec_id + more AS vec_id, label, "
    "round(list_dot_product(v, v), 6) AS norm, round(v[1], 6) AS first_entry "
    f"FROM (SELECT *, {unit_sql('embedding')} AS v FROM stretched), (VALUES (0), (1000000)) AS t(more)",
)
def d2(spark, sf_dir):
    more = stretched(spark, sf_dir).withColumn("vec_id", F.col("vec_id") + 1000000)
    v = F.col("embedding")
    return sm.append(vector_index(spark, sf_dir), more).select(
        "vec_id", "label",
        F.round(F.aggregate(F.zip_with(v, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 6)
        .alias("norm"),
        F.round(v[0], 6).alias("first_entry"),
    )


@query(
    "d3_exact_search",
    f"WITH {INDEX_SQL} SELECT query_id, rank, vec_id, label, round(s, 6) AS similarity_score "
    "FROM hits",
)
def d3(spark, sf_dir):
    index = vector_index(spark, sf_dir)
    return sm.search(index, centroids(index)).select(
        "query_id", "rank", "vec_id", "label", *rounded("similarity_score", digits=6)
    )


@query(
    "d3_tiled_search",
    f"WITH {INDEX_SQL} SELECT query_id, rank, vec_id, label, round(s, 6) AS similarity_score "
    "FROM hits",
)
def d3_tiled(spark, sf_dir):
    """The same search with the way taken for query sets too large to ship."""
    index = vector_index(spark, sf_dir)
    return sm.search(index, centroids(index), shipped_bytes=0).select(
        "query_id", "rank", "vec_id", "label", *rounded("similarity_score", digits=6)
    )


_CLUSTERS = 50
# Every vector moved close to the vector that its cluster is named after, and one query in the middle of each cluster.
_CLUSTERED_SQL = f"""
near AS (SELECT v.vec_id, list_transform(list_zip(c.embedding, v.embedding),
  lambda z: CAST(z[1] AS DOUBLE) + 0.4e0 * CAST(z[2] AS DOUBLE)) AS embedding
  FROM embeddings v JOIN embeddings c ON c.vec_id = v.vec_id % {_CLUSTERS}),
vectors AS MATERIALIZED (SELECT vec_id, {unit_sql('embedding')} AS v FROM near),
cells AS (SELECT vec_id % {_CLUSTERS} AS query_id, i, avg(v[i]) AS x FROM (SELECT vec_id, v,
  unnest(range(1, len(v) + 1)) AS i FROM vectors) GROUP BY ALL),
asked AS MATERIALIZED (SELECT query_id, {unit_sql('c')} AS q FROM (
  SELECT query_id, list(x ORDER BY i) AS c FROM cells GROUP BY query_id)),
scores AS (SELECT query_id, vec_id, round(list_dot_product(q, v), 9) AS s FROM asked CROSS JOIN vectors),
hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
  ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM scores) WHERE rank <= 5)"""


def clustered(spark, sf_dir):
    """A search table of clusters, and the mean vector of each as a query."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", (F.col("vec_id") % _CLUSTERS).alias("cluster")
    )
    centres = rows.select(F.col("vec_id").alias("cluster"), F.col("embedding").alias("centre"))
    near = rows.join(centres, "cluster").select("vec_id", "cluster", F.zip_with(
        "centre", "embedding", lambda c, x: c.cast("double") + 0.4 * x.cast("double")
    ).alias("embedding"))
    index = written(sm.build(near), "clustered")
    means = index.select("cluster", array_to_vector("embedding").alias("v")).groupBy("cluster").agg(
        Summarizer.mean(F.col("v")).alias("c")
    )
    return index, means.select(F.col("cluster").alias("query_id"), vector_to_array("c").alias("embedding"))


@query(
    "d4_approximate_search",
    f"WITH {_CLUSTERED_SQL} SELECT query_id, rank, vec_id, round(s, 6) AS similarity_score FROM hits",
)
def d4(spark, sf_dir):
    """On clustered vectors the approximate hits are the exact ones."""
    index, queries = clustered(spark, sf_dir)
    return ap.search(ap.build(index), queries).select("query_id", "rank", "vec_id", *rounded("similarity_score", digits=6))


@query(
    "d4_search_quality",
    f"SELECT least({_CLUSTERS}, count(*)) AS queries, true AS recall_reached, true AS few_met FROM embeddings",
)
def d4_quality(spark, sf_dir):
    """Recall against the exact search is at least 0.9, with less than a tenth of the table compared."""
    index, queries = clustered(spark, sf_dir)
    found = ap.search(ap.build(index), queries)
    return ap.quality(found, sm.search(index, queries), index).select(
        "queries", (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("met_share") < 0.1).alias("few_met")
    )


@query(
    "d6_similarity_features",
    f"WITH {INDEX_SQL} SELECT query_id, round(avg(s), 6) AS mean_similarity, "
    "round(avg(label / 10.0e0), 6) AS mean_historical_sentiment FROM hits GROUP BY query_id",
)
def d6(spark, sf_dir):
    index = vector_index(spark, sf_dir).withColumn("sentiment_score", F.col("label") / 10)
    queries = centroids(index)
    return sm.features(sm.search(index, queries), queries).select(
        "query_id", *rounded("mean_similarity", "mean_historical_sentiment", digits=6)
    )


@query("d7_index_size", "SELECT count(*) AS size FROM embeddings")
def d7(spark, sf_dir):
    return sm.size(table(spark, sf_dir, "embeddings"))


@query(
    "d8_first_hits",
    f"WITH {INDEX_SQL} SELECT query_id, rank, vec_id FROM hits ORDER BY query_id, rank LIMIT 10",
)
def d8(spark, sf_dir):
    index = vector_index(spark, sf_dir)
    return sm.first_hits(sm.search(index, centroids(index))).select("query_id", "rank", "vec_id")


def _slots_sql(text: str) -> str:
    words = (
        f"list_filter(regexp_split_to_array({strip_sql(f'lower({text})')}, "
        f"{_lit(SPACES_PATTERN)}), lambda w: w <> '')"
    )
    return (
        f"list_transform({words}, lambda w: "
        f"CAST(('0x' || substring(md5(w), 1, 8)) AS BIGINT) % {DIM})"
    )


# Sparse form of the same vectors: (id, slot, weighted count as a 32-bit float).
EMBEDDED_SQL = f"""
doc_slots AS MATERIALIZED (SELECT doc_id AS id, unnest({_slots_sql('text')}) AS slot
                           FROM documents),
doc_counts AS MATERIALIZED (SELECT id, slot, count(*) AS n FROM doc_slots GROUP BY ALL),
weights AS MATERIALIZED (SELECT slot, ln(((SELECT count(*) FROM documents) + 1)
  / CAST(count(*) + 1 AS DOUBLE)) AS w FROM doc_counts GROUP BY slot),
doc_vectors AS MATERIALIZED (
  SELECT id, slot, CAST(CAST(n * w AS FLOAT) AS DOUBLE) AS x FROM doc_counts JOIN weights
  USING (slot)),
doc_units AS MATERIALIZED (SELECT id, slot, x / nullif(norm, 0) AS x FROM doc_vectors JOIN (
  SELECT id, sqrt(sum(x * x)) AS norm FROM doc_vectors GROUP BY id) USING (id))"""


@query(
    "c3_headline_vectors",
    f"WITH {EMBEDDED_SQL} SELECT id AS doc_id, CAST(count(*) FILTER (WHERE x <> 0) AS BIGINT) "
    "AS slots, round(sum(x), 3) AS total, round(max(x), 3) AS largest FROM doc_vectors GROUP BY id",
)
def c3(spark, sf_dir):
    docs = em.with_slots(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    vectors = em.embed(docs, em.slot_weights(docs))
    v = F.transform("embedding", lambda x: x.cast("double"))
    return vectors.select("doc_id", v.alias("v")).select(
        "doc_id",
        F.size(F.filter("v", lambda x: x != 0)).cast("bigint").alias("slots"),
        F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 3).alias("total"),
        F.round(F.array_max("v"), 3).alias("largest"),
    )


_ASKED_SQL = f"""
ask_counts AS (SELECT id, slot, count(*) AS n FROM (SELECT item_id AS id,
  unnest({_slots_sql('text')}) AS slot FROM benchmark) GROUP BY ALL),
ask_vectors AS (SELECT id, slot, CAST(CAST(n * w AS FLOAT) AS DOUBLE) AS x
                FROM ask_counts JOIN weights USING (slot)),
ask_units AS (SELECT id, slot, x / nullif(norm, 0) AS x FROM ask_vectors JOIN (
  SELECT id, sqrt(sum(x * x)) AS norm FROM ask_vectors GROUP BY id) USING (id)),
text_scores AS (SELECT a.id AS query_id, d.id AS vec_id, round(sum(a.x * d.x), 9) AS s
                FROM ask_units a JOIN doc_units d USING (slot) GROUP BY ALL),
text_hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
  ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM text_scores) WHERE rank <= 5)"""


def text_index(spark, sf_dir):
    """All documents, embedded and stored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return TextIndex.store(docs, new_path(spark, "text-index"))


@query(
    "d5_search_by_text",
    f"WITH {EMBEDDED_SQL}, {_ASKED_SQL} SELECT query_id, rank, vec_id, round(s, 6) "
    "AS similarity_score FROM text_hits",
)
def d5(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return text_index(spark, sf_dir).search(asked).select(
        "query_id", "rank", "vec_id", *rounded("similarity_score", digits=6)
    )


@query(
    "d9_latest_headlines_search",
    f"""WITH {SCORED_SQL}, {EMBEDDED_SQL},
    latest AS (SELECT doc_id AS query_id, ticker, CAST(r AS INTEGER) AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC NULLS LAST, doc_id) AS r
      FROM scored) WHERE r <= 5),
    pair_scores AS (SELECT a.id AS query_id, d.id AS vec_id, round(sum(a.x * d.x), 9) AS s
      FROM doc_units a JOIN latest ON latest.query_id = a.id JOIN doc_units d USING (slot)
      GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id
      ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM pair_scores) WHERE rank <= 5)
    SELECT ticker, position, query_id, rank, vec_id, label, round(s, 6) AS similarity_score
    FROM latest JOIN best USING (query_id) JOIN (SELECT doc_id AS vec_id, label FROM scored)
    USING (vec_id)""",
)
def d9(spark, sf_dir):
    order = [F.col("date").desc_nulls_last(), F.col("doc_id")]
    news = headlines(spark, sf_dir).select("doc_id", "ticker", "headline", "date")
    hits = text_index(spark, sf_dir).similar_to_latest(news, order)
    labels = scored(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "label")
    return hits.join(labels, "vec_id").select(
        "ticker", "position", "query_id", "rank", "vec_id", "label",
        *rounded("similarity_score", digits=6),
    )
