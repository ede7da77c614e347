"""Registered queries over scored headlines."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import functions as F

from marketloom.functions.sentiment import SCORE_COLUMNS, Lexicon, with_sentiment
from marketloom.operators import sentiment as sn
from marketloom.plans.price_queries import rounded, rounded_sql
from marketloom.plans.registry import query
from marketloom.plans.tables import ARTICLES_SQL, HEADLINES_SQL, articles, headlines

# The provided texts are invented prose, so the finance words never occur in them; these do.
PROSE = Lexicon(
    positive=("with", "for", "by", "und", "que"),
    negative=("was", "from", "der", "des", "no"),
    neutral=("the", "of", "and", "is", "la"),
)


def words_in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


SCORED_SQL = HEADLINES_SQL + f""",
tokens AS (SELECT *, regexp_split_to_array(lower(headline), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS w
           FROM headlines),
hits AS (SELECT doc_id, headline, date, ticker, source,
  CAST(len(list_filter(w, lambda t: t IN {words_in(PROSE.positive)})) AS DOUBLE) AS p,
  CAST(len(list_filter(w, lambda t: t IN {words_in(PROSE.negative)})) AS DOUBLE) AS n,
  CAST(len(list_filter(w, lambda t: t IN {words_in(PROSE.neutral)})) AS DOUBLE) AS u FROM tokens),
grown AS (SELECT *, exp({PROSE.gain} * p / greatest(p + n + u, 1)) AS ep,
  exp({PROSE.gain} * n / greatest(p + n + u, 1)) AS en,
  exp({PROSE.gain} * u / greatest(p + n + u, 1) + {PROSE.neutral_bias}) AS eu FROM hits),
scored AS (SELECT doc_id, headline, date, ticker, source,
  CASE WHEN ep >= en AND ep >= eu THEN 'positive' WHEN en >= eu THEN 'negative'
       ELSE 'neutral' END AS label,
  ep / (ep + en + eu) AS sentiment_positive, en / (ep + en + eu) AS sentiment_negative,
  eu / (ep + en + eu) AS sentiment_neutral,
  ep / (ep + en + eu) - en / (ep + en + eu) AS sentiment_score FROM grown)"""


def scored(spark, sf_dir):
    return with_sentiment(headlines(spark, sf_dir), lexicon=PROSE)


_SCORES_SQL = (
    f"WITH {SCORED_SQL} SELECT doc_id, label, {rounded_sql(*SCORE_COLUMNS, digits=6)} FROM scored"
)


@query("c1_score_headlines", _SCORES_SQL)
def c1(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "label", *rounded(*SCORE_COLUMNS, digits=6))


def prose_scorer():
    """A user model for the scoring hook: the same rule, in Python."""
    classes = [
        re.compile(rf"\b(?:{'|'.join(words)})\b")
        for words in (PROSE.positive, PROSE.negative, PROSE.neutral)
    ]

    def score(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts.str.lower():
            p, n, u = (len(c.findall(text)) for c in classes)
            every = max(p + n + u, 1)
            ep, en = math.exp(PROSE.gain * p / every), math.exp(PROSE.gain * n / every)
            eu = math.exp(PROSE.gain * u / every + PROSE.neutral_bias)
            total = ep + en + eu
            best = "positive" if ep >= en and ep >= eu else "negative" if en >= eu else "neutral"
            rows.append((best, ep / total, en / total, eu / total, ep / total - en / total))
        return pd.DataFrame(rows, columns=["label", *SCORE_COLUMNS])

    return score


@query("c2_scorer_hook", _SCORES_SQL)
def c2(spark, sf_dir):
    rows = headlines(spark, sf_dir).select("doc_id", "headline")
    return sn.score_with(rows, prose_scorer).select(
        "doc_id", "label", *rounded(*SCORE_COLUMNS, digits=6)
    )


@query(
    "c4_label_distribution",
    f"WITH {SCORED_SQL} SELECT label, count(*) AS n, "
    "round(count(*) / CAST((SELECT count(*) FROM scored) AS DOUBLE), 6) AS share, "
    "round(avg(sentiment_score), 6) AS mean_score FROM scored GROUP BY label",
)
def c4(spark, sf_dir):
    return sn.label_distribution(scored(spark, sf_dir)).select(
        "label", "n", *rounded("share", "mean_score", digits=6)
    )


def _daily_sql(aggregate: str) -> str:
    columns = ", ".join(f"round({aggregate}({c}), 6) AS {c}" for c in SCORE_COLUMNS)
    return (
        f"WITH {SCORED_SQL} SELECT CAST(date AS DATE) AS date, ticker, {columns}, "
        "count(*) AS article_count FROM scored WHERE date IS NOT NULL GROUP BY ALL"
    )


@query("c5_daily_mean", _daily_sql("avg"))
def c5(spark, sf_dir):
    return sn.daily(scored(spark, sf_dir)).select(
        "date", "ticker", *rounded(*SCORE_COLUMNS, digits=6), "article_count"
    )


@query("c6_daily_median", _daily_sql("median"))
def c6(spark, sf_dir):
    return sn.daily(scored(spark, sf_dir), aggregation="median").select(
        "date", "ticker", *rounded(*SCORE_COLUMNS, digits=6), "article_count"
    )


@query(
    "c6_source_median",
    f"WITH {ARTICLES_SQL} SELECT CAST(date AS DATE) AS date, "
    "round(median(sentiment_score), 6) AS sentiment_score, count(*) AS article_count "
    "FROM articles GROUP BY ALL",
)
def c6_articles(spark, sf_dir):
    return sn.daily(articles(spark, sf_dir), ticker=None, aggregation="median").select(
        "date", *rounded("sentiment_score", digits=6), "article_count"
    )


@query(
    "c7_request_summary",
    f"""WITH {SCORED_SQL},
    placed AS (SELECT *, row_number() OVER (PARTITION BY ticker
               ORDER BY date DESC NULLS LAST, doc_id) AS r FROM scored)
    SELECT ticker, round(avg(sentiment_score), 6) AS current_sentiment, count(*) AS news_count,
           string_agg(headline, ' | ' ORDER BY r) FILTER (WHERE r <= 5) AS latest_headlines
    FROM placed GROUP BY ticker""",
)
def c7(spark, sf_dir):
    order = [F.col("date").desc_nulls_last(), F.col("doc_id")]
    return sn.request_summary(scored(spark, sf_dir), order, ["doc_id"]).select(
        "ticker", *rounded("current_sentiment", digits=6), "news_count",
        F.array_join("latest_headlines", " | ").alias("latest_headlines"),
    )
