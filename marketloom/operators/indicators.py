"""Technical indicators over price bars, for all instruments in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.series import decay, series_window, smooth, with_blocks
from marketloom.settings import DEFAULTS, Settings

# Indicator columns in table order.
INDICATOR_COLUMNS = (
    "rsi", "macd", "macd_signal_line", "macd_hist",
    "bb_upper", "bb_lower", "bb_pct",
    "obv", "atr",
    "returns", "log_returns", "volatility_20d",
)


def add_indicators(
    bars: DataFrame,
    keys: Sequence[str] = ("ticker",),
    order: str = "date",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Add the indicator columns and both next-day targets to daily bars.

    Needs close, high, low, volume. Everything runs on one shuffle by ``keys``: the row number
    fixes the blocks, and every later window shares the (keys, block, order) sort.
    """
    s = settings
    row = F.col("_row")
    along = series_window(keys, order)
    last_n = lambda n: along.rowsBetween(1 - n, 0)
    by_order = Window.partitionBy(*keys).orderBy(order)
    # Row number, previous and next close share one window; the blocks follow from the rows.
    df = with_blocks(
        bars.withColumns(
            {"_prev": F.lag("close").over(by_order), "_next": F.lead("close").over(by_order)}
        ),
        keys, order,
    )

    change = F.col("close") - F.col("_prev")
    df = df.withColumns(
        {
            "_gain": F.greatest(F.coalesce(change, F.lit(0.0)), F.lit(0.0)),
            "_loss": F.greatest(F.coalesce(-change, F.lit(0.0)), F.lit(0.0)),
            "_range": F.greatest(
                F.col("high") - F.col("low"),
                F.abs(F.col("high") - F.col("_prev")),
                F.abs(F.col("low") - F.col("_prev")),
            ),
            "returns": F.try_divide("close", "_prev") - 1,
            "log_returns": F.ln(F.try_divide("close", "_prev")),
            "target_direction": F.coalesce(
                (F.col("_next") > F.col("close")).cast("int"), F.lit(0)
            ),
            "target_return": F.try_divide("_next", "close") - 1,
        }
    )

    # True range is smoothed from a simple mean of the first atr_period rows.
    df = df.withColumns(
        {
            "_range_seeded": F.when(row < s.atr_period - 1, F.lit(None).cast("double"))
            .when(row == s.atr_period - 1, F.avg("_range").over(last_n(s.atr_period)))
            .otherwise(F.col("_range")),
            "_sma": F.when(
                row >= s.bollinger_period - 1, F.avg("close").over(last_n(s.bollinger_period))
            ),
            "_dev": F.when(
                row >= s.bollinger_period - 1,
                F.stddev_pop("close").over(last_n(s.bollinger_period)) * s.bollinger_std,
            ),
            "obv": F.sum(
                F.when(F.col("close") < F.col("_prev"), -F.col("volume"))
                .otherwise(F.col("volume"))
            ).over(along.rowsBetween(Window.unboundedPreceding, 0)),
            "volatility_20d": F.when(
                row >= s.volatility_period,
                F.stddev_samp("returns").over(last_n(s.volatility_period)),
            ),
        }
    )

    df = smooth(
        df,
        {
            "_gain_mean": ("_gain", 1.0 / s.rsi_period, 0),
            "_loss_mean": ("_loss", 1.0 / s.rsi_period, 0),
            "_fast": ("close", decay(s.macd_fast), 0),
            "_slow": ("close", decay(s.macd_slow), 0),
            "atr": ("_range_seeded", 1.0 / s.atr_period, s.atr_period - 1),
        },
        keys,
        order,
    )
    strength = F.try_divide("_gain_mean", "_loss_mean")
    df = df.withColumns(
        {
            "rsi": F.when(
                row >= s.rsi_period - 1,
                F.when(F.col("_loss_mean") == 0, 100.0).otherwise(100 - 100 / (1 + strength)),
            ),
            "macd": F.when(
                row >= max(s.macd_slow, s.macd_fast) - 1, F.col("_fast") - F.col("_slow")
            ),
            "bb_upper": F.col("_sma") + F.col("_dev"),
            "bb_lower": F.col("_sma") - F.col("_dev"),
        }
    )
    first_macd = max(s.macd_slow, s.macd_fast) - 1
    df = smooth(df, {"_signal": ("macd", decay(s.macd_signal), first_macd)}, keys, order)
    first_signal = first_macd + s.macd_signal - 1
    df = df.withColumn("macd_signal_line", F.when(row >= first_signal, F.col("_signal")))
    df = df.withColumns(
        {
            "macd_hist": F.col("macd") - F.col("macd_signal_line"),
            "bb_pct": F.try_divide(
                F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")
            ),
        }
    )
    return df.select(
        *bars.columns, *INDICATOR_COLUMNS, "target_direction", "target_return"
    )
