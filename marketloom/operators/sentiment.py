"""Sentiment over headline tables: scoring hooks, label shares, daily roll-up, request summary."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.sentiment import SCORE_COLUMNS
from marketloom.operators.ordering import exact_median, top_per_key
from marketloom.workspace import written

# Texts handed to a scorer at once; bounds the copies that it makes of them.
_SCORED_ROWS = 1024

Scorer = Callable[[pd.Series], pd.DataFrame]

_SCORE_TYPES = "label string, " + ", ".join(f"{c} double" for c in SCORE_COLUMNS)


def score_with(df: DataFrame, make_scorer: Callable[[], Scorer], text: str = "headline") -> DataFrame:
    """Score a text column with a user model, batch by batch.

    ``make_scorer`` runs once per task and returns a function from a batch of texts to a frame
    with the columns label and the four scores. Nothing is shuffled.
    """
    at, names = df.columns.index(text), ["label", *SCORE_COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make_scorer()
        for batch in batches:
            for low in range(0, batch.num_rows, _SCORED_ROWS):
                part = batch.slice(low, _SCORED_ROWS)
                scores = scorer(part.column(at).to_pandas())[names]
                columns = [
                    pa.array(scores[n], pa.string() if n == "label" else pa.float64(), from_pandas=True)
                    for n in names
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, {_SCORE_TYPES}")


def label_distribution(scored: DataFrame) -> DataFrame:
    """Count, share of all rows and mean score per label: one partial aggregation, three rows."""
    per_label = scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sentiment_score").alias("_sum")
    )
    # The window runs over the label rows, of which there are three.
    total = F.sum("n").over(Window.partitionBy())
    return per_label.select(
        "label", "n", (F.col("n") / total).alias("share"),
        (F.col("_sum") / F.col("n")).alias("mean_score"),
    )


def daily(
    scored: DataFrame,
    date: str = "date",
    ticker: str | None = "ticker",
    aggregation: str = "mean",
) -> DataFrame:
    """Scores and article count per calendar day (and ticker). Undated rows drop out.

    Unknown aggregation names mean ``mean``. The mean is a partial aggregate; the median is
    exact and safe for days of any size.
    """
    scores = [c for c in SCORE_COLUMNS if c in scored.columns]
    if not scores:
        raise ValueError("no sentiment columns; score the headlines first")
    keys = [date] + ([ticker] if ticker and ticker in scored.columns else [])
    dated = scored.filter(F.col(date).isNotNull()).withColumn(date, F.to_date(date))
    counts = F.count(F.lit(1)).alias("article_count")
    if aggregation != "median":
        return dated.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in scores], counts)
    # Written once and narrow: the numbering samples its input, and scoring texts is costly.
    dated = written(dated.select(*keys, *scores), "scores")
    medians = exact_median(dated, keys, scores)
    return medians.join(dated.groupBy(*keys).agg(counts), keys)


def request_summary(
    scored: DataFrame, order: Sequence[Column], tie_break: Sequence[str], headlines: int = 5
) -> DataFrame:
    """Per ticker: mean score, number of news, and its first ``headlines`` headlines in order."""
    totals = scored.groupBy("ticker").agg(
        F.avg("sentiment_score").alias("current_sentiment"),
        F.count(F.lit(1)).alias("news_count"),
    )
    total = [*order, *[F.col(c) for c in tie_break]]
    first = top_per_key(scored, ["ticker"], total, headlines).groupBy("ticker").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "headline"))), lambda x: x["headline"]
        ).alias("latest_headlines")
    )
    return totals.join(first, "ticker", "left")
