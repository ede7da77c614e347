"""Registered queries over predictions: classification, ledger, strategy metrics.

The predictor is a rule (histogram above zero means up) so that every number has an SQL twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import evaluation as ev
from marketloom.operators import splits as sp
from marketloom.operators.features import trim
from marketloom.plans.price_queries import INDICATORS_SQL, indicators, rounded, rounded_sql
from marketloom.plans.registry import query
from marketloom.plans.tables import table
from marketloom.settings import DEFAULTS

# Prices made from line items jump by whole multiples from one day to the next. A thousandth
# of each move is a realistic daily return and keeps compounded growth within comparable range.
MOVE_SHARE = 0.001

PREDICTIONS_SQL = INDICATORS_SQL + """,
kept AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos,
                count(*) OVER (PARTITION BY ticker) AS n
         FROM indicators WHERE rn >= 25 AND next_date IS NOT NULL),
predictions AS (
  SELECT ticker, date, target_direction AS actual,
         CASE WHEN macd_hist > 0 THEN 1 ELSE 0 END AS predicted,
         target_return * 0.001e0 AS actual_return, returns * 0.001e0 AS predicted_return
  FROM kept WHERE pos - floor(n * 0.85e0) >= 30 AND n - floor(n * 0.85e0) >= 31)"""

LEDGER_SQL = PREDICTIONS_SQL + """,
positions AS (SELECT *, CASE WHEN predicted = 1 THEN 1.0e0 ELSE -1.0e0 END AS position
              FROM predictions),
costs AS (SELECT *, coalesce(abs(position - lag(position) OVER
            (PARTITION BY ticker ORDER BY date)), 0.0e0) * 0.001e0 AS cost FROM positions),
days AS (SELECT *, position * actual_return - cost AS strategy_return,
                actual_return AS buyhold_return FROM costs),
ledger AS (
  SELECT *, product(1 + strategy_return) OVER w AS strategy_cumulative,
         product(1 + buyhold_return) OVER w AS buyhold_cumulative,
         10000 * product(1 + strategy_return) OVER w AS strategy_value,
         10000 * product(1 + buyhold_return) OVER w AS buyhold_value
  FROM days WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING))"""


def _sharpe_sql(r: str) -> str:
    return (
        f"coalesce((avg({r}) - 0.04e0 / 252) / nullif(stddev_pop({r}), 0) * sqrt(252), 0.0e0)"
    )


def _summary_sql(source: str, prefix: str) -> str:
    return f"""
{prefix}falls AS (
  SELECT *, strategy_cumulative / max(strategy_cumulative) OVER w - 1 AS sfall,
         buyhold_cumulative / max(buyhold_cumulative) OVER w - 1 AS bfall
  FROM {source} WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)),
{prefix}totals AS (
  SELECT ticker, arg_max(strategy_cumulative, date) - 1 AS strategy_return,
    {_sharpe_sql('strategy_return')} AS strategy_sharpe, min(sfall) AS strategy_max_drawdown,
    arg_max(strategy_value, date) AS strategy_final_value,
    arg_max(buyhold_cumulative, date) - 1 AS buyhold_return,
    {_sharpe_sql('buyhold_return')} AS buyhold_sharpe, min(bfall) AS buyhold_max_drawdown,
    arg_max(buyhold_value, date) AS buyhold_final_value,
    CAST(count_if(cost > 0) AS BIGINT) AS n_trades, sum(cost) AS total_costs
  FROM {prefix}falls GROUP BY ticker),
{prefix}summary AS (
  SELECT *, strategy_return - buyhold_return AS excess_return,
    coalesce((strategy_return - buyhold_return) / nullif(abs(buyhold_return), 0) * 100, 0.0e0)
      AS improvement_pct FROM {prefix}totals)"""


_PORTFOLIO_SQL = """
book AS (SELECT '_UNIVERSAL' AS ticker, date, avg(strategy_return) AS strategy_return,
                avg(buyhold_return) AS buyhold_return, avg(cost) AS cost
         FROM days GROUP BY date),
booked AS (
  SELECT *, product(1 + strategy_return) OVER w AS strategy_cumulative,
         product(1 + buyhold_return) OVER w AS buyhold_cumulative,
         10000 * product(1 + strategy_return) OVER w AS strategy_value,
         10000 * product(1 + buyhold_return) OVER w AS buyhold_value
  FROM book WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING))"""


def _classes_sql(key: str, source: str, prefix: str) -> str:
    return f"""
{prefix}cells AS (
  SELECT {key} AS ticker, CAST(count_if(actual = 1 AND predicted = 1) AS DOUBLE) AS tp,
    CAST(count_if(actual = 0 AND predicted = 1) AS DOUBLE) AS fp,
    CAST(count_if(actual = 1 AND predicted = 0) AS DOUBLE) AS fn,
    CAST(count_if(actual = 0 AND predicted = 0) AS DOUBLE) AS tn
  FROM {source} GROUP BY {key}),
{prefix}classes AS (
  SELECT *, (tp + tn) / (tp + fp + fn + tn) AS directional_accuracy,
    coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
    coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score FROM {prefix}cells)"""


_TOTALS = (
    "strategy_return", "strategy_sharpe", "strategy_max_drawdown", "strategy_final_value",
    "buyhold_return", "buyhold_sharpe", "buyhold_max_drawdown", "buyhold_final_value",
    "total_costs", "excess_return", "improvement_pct",
)
_CLASSES = ("directional_accuracy", "precision", "recall", "f1_score")


def predictions(spark, sf_dir):
    """Rule predictions on the test windows of every ticker."""
    test = sp.test_slice(trim(indicators(spark, sf_dir)))
    return test.filter(F.col("position") >= DEFAULTS.seq_len).select(
        "ticker", "date",
        F.col("target_direction").alias("actual"),
        F.when(F.col("macd_hist") > 0, 1).otherwise(0).alias("predicted"),
        (F.col("target_return") * MOVE_SHARE).alias("actual_return"),
        (F.col("returns") * MOVE_SHARE).alias("predicted_return"),
    )


def label_predictions(spark, sf_dir):
    """Document labels as an actual / predicted pair."""
    return table(spark, sf_dir, "labels").select(
        F.col("quality").alias("actual"), (1 - F.col("toxic")).alias("predicted")
    )


_LABELS_SQL = "judged AS (SELECT quality AS actual, 1 - toxic AS predicted FROM labels)"


@query(
    "h1_directional_accuracy",
    f"WITH {_LABELS_SQL} SELECT round(avg(CASE WHEN actual = predicted THEN 1.0e0 ELSE 0.0e0 END),"
    " 6) AS directional_accuracy FROM judged",
)
def h1(spark, sf_dir):
    return ev.accuracy(label_predictions(spark, sf_dir)).select(
        *rounded("directional_accuracy", digits=6)
    )


@query(
    "h2_confusion_matrix",
    f"WITH {_LABELS_SQL}, grid AS (SELECT * FROM (VALUES (0), (1)) a(actual), "
    "(VALUES (0), (1)) p(predicted)) SELECT g.actual, g.predicted, count(j.actual) AS n FROM grid g "
    "LEFT JOIN judged j ON j.actual = g.actual AND j.predicted = g.predicted GROUP BY ALL",
)
def h2(spark, sf_dir):
    return ev.confusion(label_predictions(spark, sf_dir))


@query(
    "h3_precision_recall",
    f"WITH {_LABELS_SQL}, {_classes_sql('1', 'judged', '')} "
    f"SELECT {rounded_sql('precision', 'recall', 'f1_score', digits=6)} FROM classes",
)
def h3(spark, sf_dir):
    return ev.precision_recall(label_predictions(spark, sf_dir)).select(
        *rounded("precision", "recall", "f1_score", digits=6)
    )


@query(
    "h4_class_report",
    f"""WITH {_LABELS_SQL}, {_classes_sql('1', 'judged', '')},
    per AS (
      SELECT 'Down' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS precision,
             coalesce(tn / nullif(tn + fp, 0), 0) AS recall,
             coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f1_score, tn + fp AS support
      FROM cells
      UNION ALL SELECT 'Up', precision, recall, f1_score, tp + fn FROM classes),
    report AS (
      SELECT * FROM per
      UNION ALL SELECT 'accuracy', directional_accuracy, directional_accuracy,
                       directional_accuracy, tp + fp + fn + tn FROM classes
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support)
                FROM per
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
                       sum(recall * support) / sum(support),
                       sum(f1_score * support) / sum(support), sum(support) FROM per)
    SELECT class, {rounded_sql('precision', 'recall', 'f1_score', digits=6)},
           CAST(support AS BIGINT) AS support FROM report""",
)
def h4(spark, sf_dir):
    return ev.class_report(label_predictions(spark, sf_dir)).select(
        "class", *rounded("precision", "recall", "f1_score", digits=6), "support"
    )


@query(
    "h5_sharpe",
    f"WITH RECURSIVE {PREDICTIONS_SQL} SELECT ticker, "
    f"round({_sharpe_sql('actual_return')}, 6) AS annual, "
    f"round({_sharpe_sql('actual_return')} / sqrt(252), 6) AS daily "
    "FROM predictions GROUP BY ticker",
)
def h5(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("ticker").agg(
        F.round(ev.sharpe("actual_return"), 6).alias("annual"),
        F.round(ev.sharpe("actual_return", annualize=False), 6).alias("daily"),
    )


@query(
    "h6_max_drawdown",
    f"WITH RECURSIVE {LEDGER_SQL}, {_summary_sql('ledger', '')} SELECT ticker, "
    "round(strategy_max_drawdown, 6) AS strategy_max_drawdown FROM summary",
)
def h6(spark, sf_dir):
    falls = ev.drawdown(ev.ledger(predictions(spark, sf_dir)), "strategy_cumulative", "fall")
    return falls.groupBy("ticker").agg(
        F.round(ev.max_drawdown("fall"), 6).alias("strategy_max_drawdown")
    )


def _ledger_query(name: str, *columns: str, digits: int = 6) -> None:
    @query(
        name,
        f"WITH RECURSIVE {LEDGER_SQL} SELECT ticker, date, {rounded_sql(*columns, digits=digits)} "
        "FROM ledger",
    )
    def run(spark, sf_dir):
        return ev.ledger(predictions(spark, sf_dir)).select(
            "ticker", "date", *rounded(*columns, digits=digits)
        )


_ledger_query("h7_positions_and_costs", "position", "cost")
_ledger_query("h8_strategy_returns", "strategy_return", "buyhold_return")
_ledger_query("h9_cumulative_growth", "strategy_cumulative", "buyhold_cumulative")


@query(
    "h10_daily_ledger",
    f"WITH RECURSIVE {LEDGER_SQL} SELECT ticker, date, predicted AS predicted_direction, "
    + rounded_sql(
        "actual_return", "position", "strategy_return", "buyhold_return", "strategy_cumulative",
        "buyhold_cumulative", "strategy_value", "buyhold_value",
    )
    + " FROM ledger",
)
def h10(spark, sf_dir):
    return ev.ledger(predictions(spark, sf_dir)).select(
        "ticker", "date", F.col("predicted").alias("predicted_direction"),
        *rounded("actual_return", "position", "strategy_return", "buyhold_return",
                 "strategy_cumulative", "buyhold_cumulative", "strategy_value", "buyhold_value"),
    )


@query(
    "h11_strategy_summary",
    f"WITH RECURSIVE {LEDGER_SQL}, {_summary_sql('ledger', '')} "
    f"SELECT ticker, {rounded_sql(*_TOTALS)}, n_trades FROM summary",
)
def h11(spark, sf_dir):
    days = ev.ledger(predictions(spark, sf_dir))
    return ev.strategy_summary(days).select("ticker", *rounded(*_TOTALS), "n_trades")


@query(
    "h12_return_error",
    f"WITH RECURSIVE {PREDICTIONS_SQL} SELECT ticker, "
    "round(avg((actual_return - predicted_return) ** 2), 6) AS mse, "
    "round(avg(abs(actual_return - predicted_return)), 6) AS mae FROM predictions GROUP BY ticker",
)
def h12(spark, sf_dir):
    return ev.return_error(predictions(spark, sf_dir), ["ticker"]).select(
        "ticker", *rounded("mse", "mae", digits=6)
    )


_EVALUATED_SQL = (
    LEDGER_SQL + "," + _summary_sql("ledger", "") + ","
    + _classes_sql("ticker", "predictions", "")
)
_ERRORS_SQL = """
errors AS (SELECT ticker, avg((actual_return - predicted_return) ** 2) AS mse,
                  avg(abs(actual_return - predicted_return)) AS mae
           FROM predictions GROUP BY ticker)"""
_CELLS = ("tn", "fp", "fn", "tp")


@query(
    "h14_per_ticker_evaluation",
    f"WITH RECURSIVE {_EVALUATED_SQL}, {_ERRORS_SQL} SELECT ticker, "
    f"{rounded_sql(*_CLASSES, *_TOTALS, 'mse', 'mae')}, n_trades, "
    f"{', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _CELLS)} "
    "FROM classes JOIN summary USING (ticker) JOIN errors USING (ticker)",
)
def h14(spark, sf_dir):
    """Every metric at once (the full evaluation), for every ticker."""
    return ev.evaluate(predictions(spark, sf_dir)).select(
        "ticker", *rounded(*_CLASSES, *_TOTALS, "mse", "mae"), "n_trades", *_CELLS
    )


@query(
    "h13_full_evaluation",
    f"WITH RECURSIVE {_EVALUATED_SQL} SELECT ticker, {rounded_sql(*_CLASSES)}, "
    f"{rounded_sql(*_TOTALS)}, n_trades FROM classes JOIN summary USING (ticker)",
)
def h13(spark, sf_dir):
    """Full evaluation of a predictor without return estimates."""
    return ev.evaluate(predictions(spark, sf_dir).drop("predicted_return")).select(
        "ticker", *rounded(*_CLASSES), *rounded(*_TOTALS), "n_trades"
    )


_UNIVERSAL_SQL = (
    _EVALUATED_SQL + "," + _PORTFOLIO_SQL + "," + _summary_sql("booked", "all_") + ","
    + _classes_sql("'_UNIVERSAL'", "predictions", "all_")
)


@query(
    "h15_universal_evaluation",
    f"WITH RECURSIVE {_UNIVERSAL_SQL} SELECT ticker, {rounded_sql(*_CLASSES, *_TOTALS)}, "
    "n_trades, (SELECT round(product(1 + strategy_return) - 1, 2) FROM days) "
    "AS chained_strategy_return, (SELECT round(product(1 + buyhold_return) - 1, 2) FROM days) "
    "AS chained_buyhold_return, "
    "(SELECT round(sum(ln(abs(1 + strategy_return))), 4) FROM days) AS chained_strategy_log, "
    "(SELECT round(sum(ln(abs(1 + buyhold_return))), 4) FROM days) AS chained_buyhold_log, "
    "(SELECT round(avg((actual_return - predicted_return) ** 2), 8) FROM predictions) AS mse, "
    "(SELECT round(avg(abs(actual_return - predicted_return)), 8) FROM predictions) AS mae "
    "FROM all_classes JOIN all_summary USING (ticker)",
)
def h15(spark, sf_dir):
    return ev.evaluate_universal(predictions(spark, sf_dir)).select(
        "ticker", *rounded(*_CLASSES, *_TOTALS), "n_trades",
        *rounded("chained_strategy_return", "chained_buyhold_return", digits=2),
        *rounded("chained_strategy_log", "chained_buyhold_log"), *rounded("mse", "mae", digits=8),
    )


SUMMARY_SQL = _UNIVERSAL_SQL + """,
table_rows AS (
  SELECT ticker, directional_accuracy, f1_score, strategy_sharpe, strategy_return,
         buyhold_return, excess_return FROM classes JOIN summary USING (ticker)
  UNION ALL
  SELECT ticker, directional_accuracy, f1_score, strategy_sharpe, strategy_return,
         buyhold_return, excess_return FROM all_classes JOIN all_summary USING (ticker))"""


@query(
    "h16_summary_table",
    f"WITH RECURSIVE {SUMMARY_SQL} SELECT ticker, {rounded_sql(*ev.SUMMARY_COLUMNS[1:])} "
    "FROM table_rows",
)
def h16(spark, sf_dir):
    return ev.summary_table(predictions(spark, sf_dir)).select(
        "ticker", *rounded(*ev.SUMMARY_COLUMNS[1:])
    )
