"""Feature matrix: sentiment onto bars, forward fill, warm-up trimming, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.sentiment import SCORE_COLUMNS
from marketloom.operators.indicators import INDICATOR_COLUMNS, add_indicators
from marketloom.settings import DEFAULTS, Settings

# Every possible feature, and the model's features (no band edges).
FEATURE_COLUMNS = (*INDICATOR_COLUMNS, *SCORE_COLUMNS)
MODEL_COLUMNS = tuple(c for c in FEATURE_COLUMNS if c not in ("bb_upper", "bb_lower"))


def ticker_sentiment(sentiment: DataFrame) -> DataFrame:
    """Mean scores per (ticker, date)."""
    return sentiment.groupBy("ticker", "date").agg(*[F.avg(c).alias(c) for c in SCORE_COLUMNS])


def join_sentiment(bars: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Left join of daily sentiment onto bars; every bar stays, unmatched days are null.

    Bars and sentiment are both grouped by (ticker, date), so neither is shuffled again.
    """
    return bars.join(ticker_sentiment(sentiment), ["ticker", "date"], "left")


def fill_sentiment(
    joined: DataFrame, keys: Sequence[str] = ("ticker",), order: str = "date"
) -> DataFrame:
    """Carry the last known scores forward per ticker; 0 before the first.

    Daily bars only: the window holds at most one row per calendar day of a ticker.
    """
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumns(
        {
            c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.lit(0.0))
            for c in SCORE_COLUMNS if c in joined.columns
        }
    )


def drop_last_bar(df: DataFrame, keys: Sequence[str] = ("ticker",), order: str = "date") -> DataFrame:
    """Remove each ticker's newest row, which has no next-day target."""
    following = F.lead(order).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_next", following).filter(F.col("_next").isNotNull()).drop("_next")


def trim(df: DataFrame, keys: Sequence[str] = ("ticker",), order: str = "date") -> DataFrame:
    """Drop warm-up rows (no rsi, macd or atr yet) and each ticker's newest row."""
    return drop_last_bar(df.dropna(subset=["rsi", "macd", "atr"]), keys, order)


def build_features(
    bars: DataFrame, sentiment: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Bars to the full feature matrix, all tickers in one plan.

    Sentiment joins first, on the partitioning the daily group-bys already have; one shuffle by
    ticker then serves the fill, every indicator and the trimming.
    """
    filled = fill_sentiment(join_sentiment(bars, sentiment))
    return trim(add_indicators(filled, settings=settings))


def feature_columns(df: DataFrame, wanted: Sequence[str] = MODEL_COLUMNS) -> list[str]:
    """The wanted feature columns the table has; none at all raises."""
    present = [c for c in wanted if c in df.columns]
    if not present:
        raise ValueError("no feature columns found")
    return present


def fit_scaler(df: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Mean and population standard deviation per feature, nulls as 0, zero deviation as 1.

    One partial aggregation to one row, turned into one row per feature.
    """
    present = feature_columns(df, columns)
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in present])
    one_row = filled.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in present],
        *[F.stddev_pop(c).alias(f"scale_{c}") for c in present],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.col(f"mean_{c}").alias("mean"),
                F.when(F.col(f"scale_{c}") == 0, 1.0).otherwise(F.col(f"scale_{c}")).alias("scale"),
            )
            for c in present
        ]
    )
    return one_row.select(F.inline(cells))


def apply_scaler(df: DataFrame, scaler: DataFrame | None) -> DataFrame:
    """Scale the features named in ``scaler``; nulls count as 0. No scaler raises.

    The parameters become one map value (an entry per feature, at most 16) that the plan reads
    as a scalar subquery, so the rows are neither joined nor shuffled.
    """
    if scaler is None:
        raise RuntimeError("no fitted scaler; fit one first")
    parameters = scaler.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale"))))
    ).scalar()
    columns = [c for c in FEATURE_COLUMNS if c in df.columns]

    def scaled(name: str):
        cell = F.try_element_at("_scaler", F.lit(name))
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        return F.when(cell.isNull(), F.col(name)).otherwise((value - cell["mean"]) / cell["scale"])

    return (
        df.withColumn("_scaler", parameters)
        .withColumns({c: scaled(c) for c in columns})
        .drop("_scaler")
    )
