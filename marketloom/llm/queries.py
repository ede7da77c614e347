"""Registered queries of the text-corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(run):
    QUERIES[run.__name__] = run
    return run


@_query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marketloom.llm.packing import pack

    return pack(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


@_query
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.repeats import repeat_report

    return repeat_report(_table(spark, sf_dir, "documents"))


@_query
def op6_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.vector_links import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


@_query
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from marketloom.llm.forest import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query
def op9_bpe_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marketloom.llm.bpe_dropout import encoded

    return encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.language import identify

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@_query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.secrets import secret_report

    return secret_report(_table(spark, sf_dir, "documents"))


@_query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.warc import archived

    return archived(_table(spark, sf_dir, "pages"))


@_query
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.content import extracted

    return extracted(_table(spark, sf_dir, "pages"))


@_query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.ranked import build, search

    return search(build(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op11_ranked_search"] = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents WHERE text IS NOT NULL
), docs AS (SELECT row, doc_id, words, len(words) AS n FROM doc_words WHERE len(words) > 0),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
normed AS (SELECT row, doc_id, words, 100 - 90 + (90 * n * big_n) // big_l AS m FROM docs, totals),
counts AS (
  SELECT row, doc_id, m, term, count(*) AS tf
  FROM (SELECT row, doc_id, m, unnest(words) AS term FROM normed) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, totals GROUP BY term, big_n
), items AS (
  SELECT row_number() OVER () AS item, item_id, unnest(list_distinct(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark WHERE text IS NOT NULL
), scored AS (
  SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM items JOIN counts USING (term) JOIN weights USING (term) GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@_query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from marketloom.llm.alignment import alignment_report

    return alignment_report(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"),
    )


@_query
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketloom.llm.licenses import license_report

    return license_report(_table(spark, sf_dir, "documents"))


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
