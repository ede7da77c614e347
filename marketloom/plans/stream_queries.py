"""Registered queries that run as streams over the landed tables.

Each stream drains what has landed and returns its sink. Windows still open at the end stay in
the state, so the SQL keeps closed windows only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketloom.plans.price_queries import rounded
from marketloom.plans.registry import query
from marketloom.plans.tables import ARTICLES_SQL, table
from marketloom.plans.text_queries import cleaned_sql
from marketloom.streaming import articles as st
from marketloom.workspace import new_path

#: Stretches of time in which the remembered stream lands.
_LANDINGS = 4
_CLOSED = "(SELECT max(date) - INTERVAL 10 MINUTE FROM articles)"


def _stream_of(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    return st.landed(spark, sf_dir, schema, pattern=f"{name}.parquet")


def scored_events(events):
    """Events as scored articles with event time."""
    score = 1 - 2 / (1 + F.col("value") / 20)
    return events.select(
        F.col("event_id").alias("article_id"),
        F.col("ts").cast("timestamp").alias("date"),
        F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("ticker"),
        F.concat_ws(" ", "event_type", F.col("value").cast("int")).alias("headline"),
        score.alias("sentiment_score"),
        F.when(score > 0.15, "positive").when(score < -0.15, "negative")
        .otherwise("neutral").alias("label"),
    )


def article_stream(spark, sf_dir):
    """Events as a stream of scored articles."""
    return scored_events(_stream_of(spark, sf_dir, "events"))


@query(
    "j1_streaming_clean",
    f"WITH {cleaned_sql('documents', 'doc_id', 'text')} SELECT doc_id, "
    "substring(text, 1, 512) AS headline FROM cleaned WHERE length(text) >= 10",
)
def j1(spark, sf_dir):
    stream = _stream_of(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("headline")
    )
    return st.drain(st.cleaned(stream), "j1").select("doc_id", "headline")


@query(
    "j2_streaming_dedupe",
    "SELECT DISTINCT md5(lower(event_type || ' ' || CAST(trunc(value) AS INTEGER))) AS hash "
    "FROM events",
)
def j2(spark, sf_dir):
    stream = st.deduplicated(article_stream(spark, sf_dir).select("headline", "date"))
    return st.drain(stream.select("hash"), "j2")


@query(
    "j2_remembered_headlines",
    f"""WITH {ARTICLES_SQL} SELECT md5(lower(source || ' ' || CAST(trunc(value) AS INTEGER))) AS hash,
      arg_min(article_id, struct_pack(date, article_id)) AS article_id, min(date) AS date
    FROM (SELECT a.*, value FROM articles a JOIN events ON article_id = event_id) GROUP BY 1""",
)
def j2_remembered(spark, sf_dir):
    """The events land in four stretches of time, beyond any watermark; the stream starts anew for each."""
    events = table(spark, sf_dir, "events")
    ends = events.select(F.min("ts"), F.max("ts")).first()
    path = new_path(spark, "j2-memory")
    low, high = (end or dt.datetime(1970, 1, 1) for end in ends)
    step, kept = (high - low) / _LANDINGS, None
    for n in range(_LANDINGS):
        part = F.col("ts") >= F.lit(low + n * step)
        if n + 1 < _LANDINGS:
            part = part & (F.col("ts") < F.lit(low + (n + 1) * step))
        events.filter(part).write.parquet(f"{path}/landed/{n}")
        landed = st.landed(spark, f"{path}/landed/*", events.schema)
        kept = st.remember(
            scored_events(landed).select("article_id", "date", "headline"), f"{path}/state"
        )
    return kept.select("hash", "article_id", F.col("date").cast("timestamp_ntz").alias("date"))


@query(
    "j3_streaming_daily",
    f"""WITH {ARTICLES_SQL} SELECT ticker, CAST(date AS DATE) AS day,
      round(avg(sentiment_score), 6) AS sentiment_score, count(*) AS article_count
    FROM articles GROUP BY ticker, CAST(date AS DATE)
    HAVING CAST(date AS DATE) + INTERVAL 1 DAY <= {_CLOSED}""",
)
def j3(spark, sf_dir):
    stream = article_stream(spark, sf_dir).select("date", "ticker", "sentiment_score")
    return st.drain(st.daily_sentiment(stream), "j3").select(
        "ticker", "day", *rounded("sentiment_score", digits=6), "article_count"
    )


@query(
    "j4_rolling_alerts",
    f"""WITH {ARTICLES_SQL}, spread AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, date)
        + (unnest(range(1, 97)) * INTERVAL 15 MINUTE) AS as_of FROM articles),
    rolled AS (SELECT ticker, as_of, count(*) AS total, avg(sentiment_score) AS average,
      CAST(count_if(label = 'negative') AS BIGINT) AS negative FROM spread GROUP BY ALL)
    SELECT ticker, as_of, total, round(average, 6) AS average, negative,
      CASE WHEN average < -0.3 THEN 'STRONG_NEG' WHEN average > 0.3 THEN 'STRONG_POS'
        WHEN negative > total * 0.6 THEN 'MAJORITY_NEG' END AS alert
    FROM rolled WHERE as_of <= {_CLOSED}""",
)
def j4(spark, sf_dir):
    stream = article_stream(spark, sf_dir).select("date", "ticker", "sentiment_score", "label")
    return st.drain(st.rolling_alerts(stream), "j4").withColumn("average", F.round("average", 6))
