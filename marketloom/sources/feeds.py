"""Landed news feeds: RSS items and Reddit listings as article tables, and their union.

Fetching is left to whatever lands the files; these scans start from the landed folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.functions.dates import instant
from marketloom.functions.text import html_to_text, strip
from marketloom.operators.ordering import top_per_key
from marketloom.settings import DEFAULTS

# Source labels, in the order in which they win duplicates.
SOURCES = ("yahoo_finance", "google_news", "reddit", "seeking_alpha")

ARTICLE_COLUMNS = ("headline", "date", "source", "ticker", "url")

RSS_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "link", "pubDate", "ticker")]
)

ATOM_SCHEMA = T.StructType([
    T.StructField("title", T.StructType([
        T.StructField("_VALUE", T.StringType()), T.StructField("_type", T.StringType()),
    ])),
    T.StructField("link", T.ArrayType(T.StructType([
        T.StructField("_href", T.StringType()), T.StructField("_rel", T.StringType()),
    ]))),
    T.StructField("published", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("ticker", T.StringType()),
])

LISTING_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("children", T.ArrayType(T.StructType([
            T.StructField("data", T.StructType([
                T.StructField("title", T.StringType()),
                T.StructField("created_utc", T.DoubleType()),
                T.StructField("permalink", T.StringType()),
            ])),
        ]))),
    ])),
])


def rss_items(items: DataFrame, source: str, markup: bool = True) -> DataFrame:
    """Feed items (title, link, pubDate, ticker) as articles; blank titles are skipped.

    ``markup=False`` leaves tags and entities of the titles as they are.
    """
    title = strip(F.col("title"))
    headline = html_to_text(title) if markup else title
    return (
        items.select(
            headline.alias("headline"),
            instant(F.col("pubDate")).alias("date"),
            F.lit(source).alias("source"),
            "ticker",
            F.coalesce("link", F.lit("")).alias("url"),
        )
        .filter(F.col("headline").isNotNull() & (strip(F.col("headline")) != ""))
    )


def atom_entries(entries: DataFrame) -> DataFrame:
    """Atom entries as feed items: the alternate link, and the day of publication or change."""
    alternate = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return entries.select(
        F.col("title._VALUE").alias("title"),
        F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get("link", F.lit(0))["_href"]).alias("link"),
        F.coalesce("published", "updated").alias("pubDate"), "ticker",
    )


def read_rss(spark: SparkSession, path: str, source: str, markup: bool = True) -> DataFrame:
    """Scan landed RSS and Atom files; every ``item`` and every ``entry`` is one article."""
    xml = spark.read.format("xml")
    items = xml.option("rowTag", "item").schema(RSS_SCHEMA).load(path)
    entries = xml.option("rowTag", "entry").schema(ATOM_SCHEMA).load(path)
    return rss_items(items.unionByName(atom_entries(entries)), source, markup)


def reddit_posts(listings: DataFrame) -> DataFrame:
    """Listings (``data.children[].data``) as articles; blank titles are skipped."""
    posts = listings.select(
        "ticker", "subreddit", F.explode("data.children.data").alias("post")
    )
    return posts.select(
        strip(F.col("post.title")).alias("headline"),
        F.expr(
            "timestamp_ntz'1970-01-01 00:00:00'"
            " + make_dt_interval(0, 0, 0, cast(post.created_utc as decimal(18, 6)))"
        ).alias("date"),
        F.concat(F.lit("reddit_r/"), "subreddit").alias("source"),
        "ticker",
        F.concat(F.lit("https://reddit.com"), F.coalesce("post.permalink", F.lit(""))).alias("url"),
    ).filter(F.col("headline") != "")


def read_reddit(spark: SparkSession, path: str) -> DataFrame:
    """Scan landed listing files, one JSON document per line."""
    return reddit_posts(spark.read.schema(LISTING_SCHEMA).json(path))


def first_feed_with_rows(entries: DataFrame, key: str = "ticker", feed: str = "feed") -> DataFrame:
    """Rows of each key's best feed (lowest number); later feeds count only if it had none.

    The best feed per key is a partial aggregate joined back on (key, feed).
    """
    best = entries.groupBy(key).agg(F.min(feed).alias(feed))
    return entries.join(best, [key, feed], "left_semi")


def newest_articles(
    sources: Sequence[DataFrame], limit: int = DEFAULTS.max_articles_per_ticker,
    tie_break: Sequence[str] = ("headline", "source", "url"),
) -> DataFrame:
    """Union of the sources, newest ``limit`` articles per ticker, undated ones last."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    order = [F.col("date").desc_nulls_last(), *[F.col(c) for c in tie_break]]
    return top_per_key(union, ["ticker"], order, limit, rank="position")


def with_company(articles: DataFrame, companies: DataFrame) -> DataFrame:
    """Add the company name of each article's ticker; the ticker stands in where none is known.

    Whether the dimension is broadcast is decided by its size (the join threshold).
    """
    named = articles.join(companies.select("ticker", "company"), "ticker", "left")
    return named.withColumn("search_name", F.coalesce("company", "ticker"))


def source_priority(source: Column) -> Column:
    """Rank of a source label in ``SOURCES``; unknown labels come last."""
    ranks = [F.when(source.startswith(s), F.lit(i)) for i, s in enumerate(SOURCES)]
    return F.coalesce(*ranks, F.lit(len(SOURCES)))
