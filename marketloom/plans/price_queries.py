"""Registered queries over bars: indicators, latest metrics and chart reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.indicators import add_indicators
from marketloom.plans.registry import query
from marketloom.plans.tables import BARS_SQL, bars
from marketloom.settings import Settings

# All exponential means in one recursion over the row number.
INDICATORS_SQL = BARS_SQL + """,
numbered AS (
  SELECT *, row_number() OVER w - 1 AS rn, lag(close) OVER w AS prev, lead(close) OVER w AS nxt,
         lead(date) OVER w AS next_date
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
steps AS (
  SELECT *, greatest(coalesce(close - prev, 0), 0) AS gain,
         greatest(coalesce(prev - close, 0), 0) AS loss,
         greatest(high - low, abs(high - prev), abs(low - prev)) AS tr,
         close / prev - 1 AS ret
  FROM numbered),
seeded AS (
  SELECT *, CASE WHEN rn = 13 THEN avg(tr) OVER (PARTITION BY ticker ORDER BY rn
                 ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS tr_seed
  FROM steps),
means(ticker, rn, g, l, e12, e26, sig, atr) AS (
  SELECT ticker, rn, gain, loss, close, close, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
  FROM seeded WHERE rn = 0
  UNION ALL
  SELECT s.ticker, s.rn, s.gain / 14 + m.g * (1 - 1.0e0 / 14),
         s.loss / 14 + m.l * (1 - 1.0e0 / 14),
         s.close * (2.0e0 / 13) + m.e12 * (1 - 2.0e0 / 13),
         s.close * (2.0e0 / 27) + m.e26 * (1 - 2.0e0 / 27),
         CASE WHEN s.rn < 25 THEN NULL
              WHEN s.rn = 25 THEN s.close * (2.0e0 / 13) + m.e12 * (1 - 2.0e0 / 13)
                - s.close * (2.0e0 / 27) - m.e26 * (1 - 2.0e0 / 27)
              ELSE 0.2e0 * (s.close * (2.0e0 / 13) + m.e12 * (1 - 2.0e0 / 13)
                - s.close * (2.0e0 / 27) - m.e26 * (1 - 2.0e0 / 27)) + 0.8e0 * m.sig END,
         CASE WHEN s.rn < 13 THEN NULL WHEN s.rn = 13 THEN s.tr_seed
              ELSE (13 * m.atr + s.tr) / 14 END
  FROM means m JOIN seeded s ON s.ticker = m.ticker AND s.rn = m.rn + 1),
indicators AS (
  SELECT s.ticker, s.date, s.open, s.high, s.low, s.close, s.volume, s.rn, s.next_date,
    CASE WHEN s.rn >= 13 THEN CASE WHEN m.l = 0 THEN 100.0e0
         ELSE 100 - 100 / (1 + m.g / m.l) END END AS rsi,
    CASE WHEN s.rn >= 25 THEN m.e12 - m.e26 END AS macd,
    CASE WHEN s.rn >= 33 THEN m.sig END AS macd_signal_line,
    CASE WHEN s.rn >= 33 THEN m.e12 - m.e26 - m.sig END AS macd_hist,
    CASE WHEN s.rn >= 19 THEN avg(s.close) OVER w20 + 2 * stddev_pop(s.close) OVER w20 END
      AS bb_upper,
    CASE WHEN s.rn >= 19 THEN avg(s.close) OVER w20 - 2 * stddev_pop(s.close) OVER w20 END
      AS bb_lower,
    CASE WHEN s.rn >= 19 THEN (s.close - (avg(s.close) OVER w20
         - 2 * stddev_pop(s.close) OVER w20))
      / nullif(4 * stddev_pop(s.close) OVER w20, 0) END AS bb_pct,
    sum(CASE WHEN s.close < s.prev THEN -s.volume ELSE s.volume END) OVER wall AS obv,
    m.atr, s.ret AS returns, ln(s.close / s.prev) AS log_returns,
    CASE WHEN s.rn >= 20 THEN stddev_samp(s.ret) OVER w20 END AS volatility_20d,
    coalesce(CAST(s.nxt > s.close AS INTEGER), 0) AS target_direction,
    s.nxt / s.close - 1 AS target_return
  FROM seeded s JOIN means m ON m.ticker = s.ticker AND m.rn = s.rn
  WINDOW w20 AS (PARTITION BY s.ticker ORDER BY s.rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
         wall AS (PARTITION BY s.ticker ORDER BY s.rn ROWS UNBOUNDED PRECEDING))"""


def rounded(*names: str, digits: int = 4) -> list:
    return [F.round(n, digits).alias(n) for n in names]


def rounded_sql(*names: str, digits: int = 4) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_indicators(bars(spark, sf_dir))


def _indicator_query(name: str, *columns: str) -> None:
    """Register one query that returns (ticker, date) and the given indicator columns."""
    sql = (
        f"WITH RECURSIVE {INDICATORS_SQL} SELECT ticker, date, {rounded_sql(*columns)} "
        "FROM indicators"
    )

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return indicators(spark, sf_dir).select("ticker", "date", *rounded(*columns))


_indicator_query("e1_rsi", "rsi")
_indicator_query("e2_macd", "macd")
_indicator_query("e3_macd_signal", "macd_signal_line", "macd_hist")
_indicator_query("e4_bollinger", "bb_upper", "bb_lower")
_indicator_query("e5_bollinger_pct", "bb_pct")
_indicator_query("e6_obv", "obv")
_indicator_query("e7_atr", "atr")
_indicator_query("e8_simple_return", "returns")
_indicator_query("e9_log_return", "log_returns")
_indicator_query("e10_volatility", "volatility_20d")
_indicator_query("e11_next_direction", "target_direction")
_indicator_query("e12_next_return", "target_return")


# Other periods: one recursion each over the numbered bars.
_PERIODS = Settings(rsi_period=21, macd_slow=50, macd_signal=2, atr_period=20)
_STEPS_SQL = INDICATORS_SQL[: INDICATORS_SQL.index(",\nseeded AS")]


@query(
    "e1_rsi_21",
    f"""WITH RECURSIVE {_STEPS_SQL}, walk(ticker, rn, g, l) AS (
      SELECT ticker, rn, gain, loss FROM steps WHERE rn = 0
      UNION ALL SELECT s.ticker, s.rn, s.gain / 21 + w.g * (1 - 1.0e0 / 21),
        s.loss / 21 + w.l * (1 - 1.0e0 / 21)
      FROM walk w JOIN steps s ON s.ticker = w.ticker AND s.rn = w.rn + 1)
    SELECT s.ticker, s.date, round(CASE WHEN s.rn >= 20 THEN CASE WHEN w.l = 0 THEN 100.0e0
      ELSE 100 - 100 / (1 + w.g / w.l) END END, 4) AS rsi
    FROM steps s JOIN walk w ON w.ticker = s.ticker AND w.rn = s.rn""",
)
def rsi_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_indicators(bars(spark, sf_dir), settings=_PERIODS).select("ticker", "date", *rounded("rsi"))


@query(
    "e2_macd_50",
    f"""WITH RECURSIVE {_STEPS_SQL}, walk(ticker, rn, fast, slow, sig) AS (
      SELECT ticker, rn, close, close, CAST(NULL AS DOUBLE) FROM steps WHERE rn = 0
      UNION ALL SELECT s.ticker, s.rn, s.close * (2.0e0 / 13) + w.fast * (1 - 2.0e0 / 13),
        s.close * (2.0e0 / 51) + w.slow * (1 - 2.0e0 / 51),
        CASE WHEN s.rn < 49 THEN NULL WHEN s.rn = 49 THEN
          s.close * (2.0e0 / 13) + w.fast * (1 - 2.0e0 / 13)
          - s.close * (2.0e0 / 51) - w.slow * (1 - 2.0e0 / 51)
        ELSE (2.0e0 / 3) * (s.close * (2.0e0 / 13) + w.fast * (1 - 2.0e0 / 13)
          - s.close * (2.0e0 / 51) - w.slow * (1 - 2.0e0 / 51)) + (1 - 2.0e0 / 3) * w.sig END
      FROM walk w JOIN steps s ON s.ticker = w.ticker AND s.rn = w.rn + 1)
    SELECT s.ticker, s.date, round(CASE WHEN s.rn >= 49 THEN w.fast - w.slow END, 4) AS macd,
      round(CASE WHEN s.rn >= 50 THEN w.sig END, 4) AS macd_signal_line
    FROM steps s JOIN walk w ON w.ticker = s.ticker AND w.rn = s.rn""",
)
def macd_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_indicators(bars(spark, sf_dir), settings=_PERIODS).select(
        "ticker", "date", *rounded("macd", "macd_signal_line")
    )


@query(
    "e7_atr_20",
    f"""WITH RECURSIVE {_STEPS_SQL}, seeds AS (SELECT *, avg(tr) OVER (PARTITION BY ticker
        ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS seed FROM steps),
    walk(ticker, rn, atr) AS (
      SELECT ticker, rn, seed FROM seeds WHERE rn = 19
      UNION ALL SELECT s.ticker, s.rn, (19 * w.atr + s.tr) / 20
      FROM walk w JOIN seeds s ON s.ticker = w.ticker AND s.rn = w.rn + 1)
    SELECT s.ticker, s.date, round(w.atr, 4) AS atr
    FROM steps s LEFT JOIN walk w ON w.ticker = s.ticker AND w.rn = s.rn""",
)
def atr_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_indicators(bars(spark, sf_dir), settings=_PERIODS).select("ticker", "date", *rounded("atr"))
