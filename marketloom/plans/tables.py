"""The provided tables in the roles this library works on: bars, headlines, articles, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.sources.bars import daily_bars

BRANDS = 25
FIRST_DAY = "1995-01-02"
DAYS = 2499


# Tables whose rows are costly to work on, with the key that spreads them evenly.
SPREAD_BY = {"documents": "doc_id", "pages": "page_id", "lineitem": "l_orderkey"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread the rows of a test table whose one file is too few tasks for the cores here."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(key) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one provided table; costly ones that come in too few splits are spread."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, SPREAD_BY[name]) if name in SPREAD_BY else rows


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades: brand is the instrument, unit price the trade price."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice", "l_shipdate",
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("ticker"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: at most one row per brand and calendar day, whatever the table size."""
    return daily_bars(
        trades(spark, sf_dir),
        sequence={"l_orderkey": 52, "l_linenumber": 8, "l_partkey": 36, "l_suppkey": 27},
    )


def _brand_of(number: Column) -> Column:
    return F.concat(F.lit("Brand#"), (number % BRANDS + 1).cast("string"))


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as headlines, whole texts. Source ``src0`` is undated, as bulk news files are."""
    key = F.col("doc_id")
    stamp = F.expr(
        f"timestamp_ntz'{FIRST_DAY} 00:00:00' + make_dt_interval("
        f"cast(doc_id * 37 % {DAYS} as int), cast(doc_id % 24 as int))"
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("headline"),
        F.when(F.col("source") != "src0", stamp).alias("date"),
        _brand_of(key).alias("ticker"),
        "source",
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored articles. The score is squeezed from ``value`` into (-1, 1)."""
    score = 1 - 2 / (1 + F.col("value") / 20)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("article_id"),
        F.col("ts").alias("date"),
        _brand_of(F.col("user_id")).alias("ticker"),
        F.col("event_type").alias("source"),
        score.alias("sentiment_score"),
        F.when(score > 0.15, "positive").when(score < -0.15, "negative")
        .otherwise("neutral").alias("label"),
    )


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as feed entries: the raw title element, the link and the instrument."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"),
        F.col("url").alias("link"),
        _brand_of(F.col("page_id")).alias("ticker"),
    )


# The same roles in SQL, for the oracle queries.
TRADES_SQL = """
trades AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
         l_extendedprice / l_quantity AS price, l_quantity AS volume,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

BARS_SQL = TRADES_SQL + """,
bars AS (
  SELECT ticker, date,
         first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, price, volume)
           AS open,
         max(price) AS high, min(price) AS low,
         last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, price, volume)
           AS close,
         sum(volume) AS volume
  FROM trades GROUP BY ticker, date)"""

HEADLINES_SQL = f"""
headlines AS (
  SELECT doc_id, text AS headline,
         CASE WHEN source <> 'src0' THEN TIMESTAMP '{FIRST_DAY}'
           + to_days(CAST(doc_id * 37 % {DAYS} AS INTEGER)) + to_hours(doc_id % 24) END AS date,
         'Brand#' || CAST(doc_id % {BRANDS} + 1 AS VARCHAR) AS ticker, source
  FROM documents)"""

ARTICLES_SQL = f"""
articles AS (
  SELECT *, CASE WHEN sentiment_score > 0.15 THEN 'positive'
                 WHEN sentiment_score < -0.15 THEN 'negative' ELSE 'neutral' END AS label
  FROM (SELECT event_id AS article_id, ts AS date,
               'Brand#' || CAST(user_id % {BRANDS} + 1 AS VARCHAR) AS ticker,
               event_type AS source, 1 - 2 / (1 + value / 20) AS sentiment_score FROM events))"""

FEED_SQL = f"""
feed AS (
  SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
         url AS link, 'Brand#' || CAST(page_id % {BRANDS} + 1 AS VARCHAR) AS ticker
  FROM pages)"""
