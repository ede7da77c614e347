"""Daily price bars: building, scanning by date range, freshness, schema checks and the sink."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.ordering import packed, top_per_key
from marketloom.settings import DEFAULTS

# Columns every bar table must have.
BAR_COLUMNS = ("date", "open", "high", "low", "close", "volume")


def daily_bars(trades: DataFrame, sequence: Mapping[str, int] | Sequence[str]) -> DataFrame:
    """Aggregate trades (ticker, date, price, volume) to one bar per ticker and day.

    ``sequence`` orders the trades of a day for open and close and tells them apart; trades that
    share it are copies with one price. Given with the bits each of its columns needs, it is
    packed into one number, so all aggregates are hashed and combined before the shuffle: one heavily
    traded ticker or day sends one partial row per task. Without bits the types decide; a sequence
    too wide for one number is compared column by column, with price and volume behind it, which sorts.
    """
    widths = list(sequence.values()) if isinstance(sequence, Mapping) else None
    key = packed(trades, list(sequence), widths)
    if key is None:
        key = F.struct(*sequence, "price", "volume")
    return trades.withColumn("_order", key).groupBy("ticker", "date").agg(
        F.min_by("price", "_order").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_order").alias("close"),
        F.sum("volume").alias("volume"),
    )


def in_range(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars with ``start <= date < end``; the start defaults to the configured first day."""
    kept = bars.filter(F.col("date") >= F.lit(start or DEFAULTS.start_date).cast("date"))
    return kept.filter(F.col("date") < F.lit(end).cast("date")) if end else kept


def for_tickers(bars: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Bars of several instruments in one scan; unknown instruments contribute nothing."""
    if not tickers:
        raise ValueError("no tickers requested")
    return bars.filter(F.col("ticker").isin(list(tickers)))


def freshness(bars: DataFrame, end: Column) -> DataFrame:
    """Per ticker: newest bar and whether it reaches ``end`` minus one day."""
    return bars.groupBy("ticker").agg(F.max("date").alias("last_date")).withColumn(
        "is_fresh", F.col("last_date") >= F.date_sub(end, 1)
    )


def latest_price(bars: DataFrame) -> DataFrame:
    """Per ticker: last close and the close before it, from its two newest bars."""
    newest = top_per_key(
        bars.select("ticker", "date", "close"), ["ticker"], [F.col("date").desc()], 2
    )
    return newest.groupBy("ticker").agg(
        F.max(F.when(F.col("rank") == 1, F.col("close"))).alias("last_price"),
        F.max(F.when(F.col("rank") == 2, F.col("close"))).alias("previous_close"),
    )


def flatten_names(df: DataFrame) -> DataFrame:
    """Two-level headers such as ``('Close', 'AAPL')`` become their first level, lower case."""
    def first_level(name: str) -> str:
        return name.strip("()").split(",")[0].strip().strip("'\"").lower()

    return df.toDF(*[first_level(c) for c in df.columns])


def missing_columns(df: DataFrame) -> list[str]:
    """Expected bar columns the table lacks."""
    return [c for c in BAR_COLUMNS if c not in df.columns]


def write_bars(bars: DataFrame, path: str) -> None:
    """Store bars partitioned by ticker, sorted by date.

    A ticker has at most one bar per calendar day, so its folder is written by one task as one
    file, and a scan of one ticker prunes to that file.
    """
    (
        bars.repartition("ticker")
        .sortWithinPartitions("ticker", "date")
        .write.mode("overwrite").partitionBy("ticker").parquet(path)
    )


def read_bars(
    spark: SparkSession,
    path: str,
    tickers: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Scan stored bars: ticker prunes folders, the date range is pushed into Parquet."""
    bars = spark.read.parquet(path)
    if tickers is not None:
        bars = for_tickers(bars, tickers)
    return in_range(bars, start, end)
