"""Registered queries over the feature matrix: joins, fill, scaling, splits, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.sentiment import SCORE_COLUMNS
from marketloom.operators import features as ft
from marketloom.operators import sentiment as sn
from marketloom.operators import splits as sp
from marketloom.operators.indicators import INDICATOR_COLUMNS
from marketloom.operators.series import in_chunks, running, smooth, with_blocks
from marketloom.plans.price_queries import INDICATORS_SQL, indicators, rounded, rounded_sql
from marketloom.plans.registry import query
from marketloom.plans.sentiment_queries import SCORED_SQL, scored
from marketloom.plans.tables import BARS_SQL, bars, table
from marketloom.workspace import written

ALL_FEATURES = (*INDICATOR_COLUMNS, *SCORE_COLUMNS)

_DAILY_SQL = f"""
daily AS (SELECT CAST(date AS DATE) AS date, ticker,
  {", ".join(f"avg({c}) AS {c}" for c in SCORE_COLUMNS)}
  FROM scored WHERE date IS NOT NULL GROUP BY ALL)"""

_FILLED = ", ".join(
    f"coalesce(last_value(d.{c} IGNORE NULLS) OVER (PARTITION BY b.ticker ORDER BY b.date "
    f"ROWS UNBOUNDED PRECEDING), 0.0e0) AS {c}" for c in SCORE_COLUMNS
)

FEATURES_SQL = INDICATORS_SQL + "," + SCORED_SQL + "," + _DAILY_SQL + f""",
filled AS (SELECT b.ticker, b.date, {_FILLED}
           FROM bars b LEFT JOIN daily d ON d.ticker = b.ticker AND d.date = b.date),
features AS (
  SELECT i.* EXCLUDE (rn, next_date), {", ".join("f." + c for c in SCORE_COLUMNS)},
         row_number() OVER (PARTITION BY i.ticker ORDER BY i.date) - 1 AS pos,
         count(*) OVER (PARTITION BY i.ticker) AS n
  FROM indicators i JOIN filled f ON f.ticker = i.ticker AND f.date = i.date
  WHERE i.rn >= 25 AND i.next_date IS NOT NULL),
split AS (
  SELECT *, CASE WHEN pos < floor(n * 0.70e0) THEN 'train'
                 WHEN pos < floor(n * 0.85e0) THEN 'val' ELSE 'test' END AS split
  FROM features)"""


def daily_sentiment(spark, sf_dir):
    return sn.daily(scored(spark, sf_dir))


def features(spark, sf_dir):
    return ft.build_features(bars(spark, sf_dir), daily_sentiment(spark, sf_dir))


@query(
    "e13_ticker_sentiment",
    f"WITH {SCORED_SQL}, {_DAILY_SQL} SELECT ticker, date, {rounded_sql(*SCORE_COLUMNS, digits=6)} "
    "FROM daily",
)
def e13(spark, sf_dir):
    return ft.ticker_sentiment(daily_sentiment(spark, sf_dir)).select(
        "ticker", "date", *rounded(*SCORE_COLUMNS, digits=6)
    )


@query(
    "e14_join_sentiment",
    f"WITH {BARS_SQL}, {SCORED_SQL}, {_DAILY_SQL} SELECT ticker, date, close, "
    f"{rounded_sql(*SCORE_COLUMNS, digits=6)} FROM bars LEFT JOIN daily USING (ticker, date)",
)
def e14(spark, sf_dir):
    return ft.join_sentiment(bars(spark, sf_dir), daily_sentiment(spark, sf_dir)).select(
        "ticker", "date", "close", *rounded(*SCORE_COLUMNS, digits=6)
    )


@query(
    "e15_fill_sentiment",
    f"WITH {BARS_SQL}, {SCORED_SQL}, {_DAILY_SQL}, filled AS (SELECT b.ticker, b.date, {_FILLED} "
    "FROM bars b LEFT JOIN daily d ON d.ticker = b.ticker AND d.date = b.date) "
    f"SELECT ticker, date, {rounded_sql(*SCORE_COLUMNS, digits=6)} FROM filled",
)
def e15(spark, sf_dir):
    joined = ft.join_sentiment(bars(spark, sf_dir), daily_sentiment(spark, sf_dir))
    return ft.fill_sentiment(joined).select(
        "ticker", "date", *rounded(*SCORE_COLUMNS, digits=6)
    )


@query(
    "e16_trim_warmup",
    f"WITH RECURSIVE {INDICATORS_SQL} SELECT ticker, date, {rounded_sql('rsi', 'macd', 'atr')} "
    "FROM indicators WHERE rn >= 25 AND next_date IS NOT NULL",
)
def e16(spark, sf_dir):
    return ft.trim(indicators(spark, sf_dir)).select(
        "ticker", "date", *rounded("rsi", "macd", "atr")
    )


_SMOOTHED_SQL = """WITH RECURSIVE ticks AS (
  SELECT event_type, event_id, value,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rn FROM events),
walk(event_type, event_id, rn, y) AS (
  SELECT event_type, event_id, rn, value FROM ticks WHERE rn = 0
  UNION ALL
  SELECT t.event_type, t.event_id, t.rn, t.value / 14 + w.y * (1 - 1.0e0 / 14)
  FROM walk w JOIN ticks t ON t.event_type = w.event_type AND t.rn = w.rn + 1)
SELECT event_type, event_id, round(y, 4) AS smoothed FROM walk"""


@query("e17_smooth_ticks", _SMOOTHED_SQL)
def e17(spark, sf_dir):
    """Tick-level series: five keys share all rows, so each is cut into chunks."""
    ticks = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")

    def build(rows, keys):
        blocks = with_blocks(rows, keys, "_position")
        return smooth(blocks, {"smoothed": ("value", 1 / 14, 0)}, keys, "_position").drop(
            "_row", "_block"
        )

    return in_chunks(
        ticks, ["event_type"], ["ts", "event_id"], build, alphas=[1 / 14]
    ).select(
        "event_type", "event_id", *rounded("smoothed")
    )


@query(
    "e6_running_ticks",
    """SELECT event_type, event_id, round(sum(CASE WHEN value < prev THEN -value ELSE value END)
       OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS balance
    FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev
          FROM events)""",
)
def e6_ticks(spark, sf_dir):
    """Signed running volume of tick-level series of any length."""
    ticks = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")

    def build(rows, keys):
        prev = F.lag("value").over(sp.Window.partitionBy(*keys).orderBy("_position"))
        return rows.withColumn("signed", F.when(F.col("value") < prev, -F.col("value"))
                               .otherwise(F.col("value")))

    order = ["ts", "event_id"]
    signed = in_chunks(ticks, ["event_type"], order, build, chunk_rows=1024, back=1, ahead=0)
    return running(
        signed, ["event_type"], order, F.col("signed"), "balance", chunk_rows=1024
    ).select("event_type", "event_id", *rounded("balance"))


@query(
    "e15_fill_ticks",
    """SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END
       IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
       0.0e0) AS last_purchase FROM events""",
)
def e15_ticks(spark, sf_dir):
    """Forward fill of tick-level series of any length."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts",
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"),
    )
    filled = running(
        events, ["user_id"], ["ts", "event_id"], F.col("paid"), "last", kind="last", chunk_rows=16
    )
    return filled.select("event_id", F.coalesce("last", F.lit(0.0)).alias("last_purchase"))


@query(
    "e18_feature_selection",
    f"WITH RECURSIVE {FEATURES_SQL} SELECT ticker, date, {rounded_sql(*ft.MODEL_COLUMNS)} "
    "FROM features",
)
def e18(spark, sf_dir):
    rows = features(spark, sf_dir)
    return rows.select("ticker", "date", *rounded(*ft.feature_columns(rows)))


_FIT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(coalesce({c}, 0)) AS mean, "
    f"CASE WHEN stddev_pop(coalesce({c}, 0)) = 0 THEN 1 ELSE stddev_pop(coalesce({c}, 0)) END "
    "AS scale FROM train" for c in ALL_FEATURES
)
SCALER_SQL = FEATURES_SQL + f""",
train AS MATERIALIZED (SELECT * FROM split WHERE split = 'train'),
scaler AS MATERIALIZED ({_FIT_SQL})"""


@query(
    "e19_fit_scaler",
    f"WITH RECURSIVE {SCALER_SQL} SELECT feature, {rounded_sql('mean', 'scale')} FROM scaler",
)
def e19(spark, sf_dir):
    labelled = sp.split_per_ticker(features(spark, sf_dir))
    return ft.fit_scaler(labelled.filter(F.col("split") == "train")).select(
        "feature", *rounded("mean", "scale")
    )


def _scaled_sql(c: str) -> str:
    return (
        f"round((coalesce({c}, 0) - (SELECT mean FROM scaler WHERE feature = '{c}')) / "
        f"(SELECT scale FROM scaler WHERE feature = '{c}'), 4) AS {c}"
    )


@query(
    "e20_apply_scaler",
    f"WITH RECURSIVE {SCALER_SQL} SELECT ticker, date, split, "
    f"{', '.join(_scaled_sql(c) for c in ALL_FEATURES)} FROM split",
)
def e20(spark, sf_dir):
    return scaled_features(spark, sf_dir).select(
        "ticker", "date", "split", *rounded(*ALL_FEATURES)
    )


def scaled_features(spark, sf_dir):
    """Split features, scaled with parameters of the training rows.

    The feature matrix is read twice (fit, transform), so it is written once.
    """
    labelled = written(sp.split_per_ticker(features(spark, sf_dir)), "features")
    return ft.apply_scaler(labelled, ft.fit_scaler(labelled.filter(F.col("split") == "train")))


@query(
    "e21_feature_build",
    f"WITH RECURSIVE {FEATURES_SQL} SELECT ticker, date, "
    f"open, high, low, close, volume, {rounded_sql(*ALL_FEATURES, 'target_return')}, "
    "target_direction FROM features",
)
def e21(spark, sf_dir):
    return features(spark, sf_dir).select(
        "ticker", "date", "open", "high", "low", "close", "volume",
        *rounded(*ALL_FEATURES, "target_return"),
        "target_direction",
    )


@query(
    "e22_rows_per_ticker",
    f"WITH RECURSIVE {FEATURES_SQL} SELECT ticker AS _ticker, count(*) AS n FROM features "
    "GROUP BY ticker",
)
def e22(spark, sf_dir):
    """All tickers come from one plan; the tag is the ticker column."""
    return features(spark, sf_dir).groupBy(F.col("ticker").alias("_ticker")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "f1_chronological_split",
    f"""WITH RECURSIVE {FEATURES_SQL},
    placed AS (SELECT ticker, date, row_number() OVER (ORDER BY date, ticker) - 1 AS p,
                      count(*) OVER () AS total FROM features)
    SELECT ticker, date, CASE WHEN p < floor(total * 0.70e0) THEN 'train'
      WHEN p < floor(total * 0.85e0) THEN 'val' ELSE 'test' END AS split FROM placed""",
)
def f1(spark, sf_dir):
    rows = features(spark, sf_dir).select("ticker", "date")
    return sp.split_all(rows, ["date", "ticker"])


@query("f2_split_per_ticker", f"WITH RECURSIVE {FEATURES_SQL} SELECT ticker, date, split FROM split")
def f2(spark, sf_dir):
    return sp.split_per_ticker(features(spark, sf_dir)).select("ticker", "date", "split")


@query(
    "f3_test_slice",
    f"WITH RECURSIVE {FEATURES_SQL} SELECT ticker, date, "
    "CAST(pos - floor(n * 0.85e0) AS INTEGER) AS position FROM split WHERE split = 'test' "
    "AND n - floor(n * 0.85e0) >= 31",
)
def f3(spark, sf_dir):
    return sp.test_slice(features(spark, sf_dir)).select("ticker", "date", "position")


_PAST = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"


@query(
    "f4_sliding_windows",
    f"""WITH RECURSIVE {FEATURES_SQL}
    SELECT ticker, date, target_direction, round(target_return, 4) AS target_return,
           CAST(30 AS INTEGER) AS steps, oldest_rsi, newest_rsi, total FROM (
      SELECT *, count(*) {_PAST} AS c, round(first_value(rsi) {_PAST}, 4) AS oldest_rsi,
             round(last_value(rsi) {_PAST}, 4) AS newest_rsi,
             round(sum({" + ".join(f"coalesce({c}, 0)" for c in ft.MODEL_COLUMNS)}) {_PAST}, 2)
               AS total FROM features) WHERE c = 30""",
)
def f4(spark, sf_dir):
    add = lambda a, b: a + b
    return sp.sequences(features(spark, sf_dir)).select(
        "ticker", "date", "target_direction", *rounded("target_return"),
        F.size("sequence").alias("steps"),
        F.round(F.col("sequence")[0][0], 4).alias("oldest_rsi"),
        F.round(F.col("sequence")[29][0], 4).alias("newest_rsi"),
        F.round(F.aggregate(F.flatten("sequence"), F.lit(0.0), add), 2).alias("total"),
    )


@query(
    "f5_missing_targets",
    f"""WITH {BARS_SQL} SELECT ticker, date, CAST(0 AS INTEGER) AS target_direction,
    0.0e0 AS target_return FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date)
    AS r FROM bars) WHERE r > 30""",
)
def f5(spark, sf_dir):
    """Samples of a table without targets: both default to 0."""
    return sp.sequences(bars(spark, sf_dir), columns=["close", "volume"]).drop("sequence")
