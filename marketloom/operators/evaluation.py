"""Classification metrics and strategy ledgers, per ticker and pooled.

Predictions are daily: at most one row per (ticker, date), so ledger windows by ticker are
bounded by the calendar. Everything else is partial aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.settings import DEFAULTS, Settings
from marketloom.workspace import written

UNIVERSAL = "_UNIVERSAL"
CLASS_NAMES = {0: "Down", 1: "Up"}


def _share(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def _counts(actual: str, predicted: str) -> dict[str, Column]:
    a, p = F.col(actual), F.col(predicted)
    return {
        "tp": F.count_if((a == 1) & (p == 1)), "fp": F.count_if((a == 0) & (p == 1)),
        "fn": F.count_if((a == 1) & (p == 0)), "tn": F.count_if((a == 0) & (p == 0)),
    }


def accuracy(df: DataFrame, keys: Sequence[str] = (), actual="actual", predicted="predicted"):
    """Share of rows whose prediction matches."""
    return df.groupBy(*keys).agg(
        F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("directional_accuracy")
    )


def confusion(df: DataFrame, keys: Sequence[str] = (), actual="actual", predicted="predicted"):
    """The 2x2 counts as rows (actual, predicted, n), empty cells as 0."""
    counts = df.groupBy(*keys).agg(*[c.alias(n) for n, c in _counts(actual, predicted).items()])
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(n).alias("n"))
            for a, p, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
        ]
    )
    return counts.select(*keys, F.inline(cells))


def precision_recall(df: DataFrame, keys: Sequence[str] = (), actual="actual", predicted="predicted"):
    """Precision, recall and F1 of the up class; undefined ratios are 0."""
    counts = df.groupBy(*keys).agg(*[c.alias(n) for n, c in _counts(actual, predicted).items()])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *keys,
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def class_report(df: DataFrame, keys: Sequence[str] = (), actual="actual", predicted="predicted"):
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted rows."""
    c = df.groupBy(*keys).agg(*[c.alias(n) for n, c in _counts(actual, predicted).items()])
    cells = []
    for name, hit, false_hit, missed in (
        (CLASS_NAMES[0], "tn", "fn", "fp"), (CLASS_NAMES[1], "tp", "fp", "fn"),
    ):
        h, f, m = F.col(hit), F.col(false_hit), F.col(missed)
        c = c.withColumn(
            name,
            F.struct(
                F.lit(name).alias("class"), _share(h, h + f).alias("precision"),
                _share(h, h + m).alias("recall"), _share(2 * h, 2 * h + f + m).alias("f1_score"),
                (h + m).alias("support"),
            ),
        )
        cells.append(name)
    down, up = (F.col(n) for n in cells)
    support = down["support"] + up["support"]
    fields = ("precision", "recall", "f1_score")
    right = _share(F.col("tp") + F.col("tn"), support)
    rows = F.array(
        down, up,
        F.struct(F.lit("accuracy").alias("class"), *[right.alias(f) for f in fields],
                 support.alias("support")),
        F.struct(F.lit("macro avg").alias("class"),
                 *[((down[f] + up[f]) / 2).alias(f) for f in fields], support.alias("support")),
        F.struct(F.lit("weighted avg").alias("class"),
                 *[_share(down[f] * down["support"] + up[f] * up["support"], support).alias(f)
                   for f in fields],
                 support.alias("support")),
    )
    return c.select(*keys, F.inline(rows))


def sharpe(returns: str, annualize: bool = True, settings: Settings = DEFAULTS) -> Column:
    """Sharpe ratio of a return column as an aggregate; 0 for no rows or no variation."""
    daily_rate = settings.risk_free_rate / settings.trading_days_per_year
    factor = math.sqrt(settings.trading_days_per_year) if annualize else 1.0
    ratio = (F.avg(returns) - daily_rate) / F.nullif(F.stddev_pop(returns), F.lit(0.0)) * factor
    return F.coalesce(ratio, F.lit(0.0))


def ledger(
    df: DataFrame, keys: Sequence[str] = ("ticker",), order: str = "date",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Daily strategy ledger from (actual_return, predicted).

    Long when up is predicted, short otherwise; a change of position costs, the first position
    does not. Growth is a running product, so returns at or below -100% stay exact.
    """
    s = settings
    along = Window.partitionBy(*keys).orderBy(order)
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("position", F.when(F.col("predicted") == 1, 1.0).otherwise(-1.0))
    df = df.withColumn(
        "cost",
        F.coalesce(F.abs(F.col("position") - F.lag("position").over(along)), F.lit(0.0))
        * s.transaction_cost,
    )
    df = df.withColumns(
        {
            "strategy_return": F.col("position") * F.col("actual_return") - F.col("cost"),
            "buyhold_return": F.col("actual_return"),
        }
    )
    df = df.withColumns(
        {
            "strategy_cumulative": F.product(1 + F.col("strategy_return")).over(so_far),
            "buyhold_cumulative": F.product(1 + F.col("buyhold_return")).over(so_far),
        }
    )
    return df.withColumns(
        {
            "strategy_value": F.col("strategy_cumulative") * s.initial_capital,
            "buyhold_value": F.col("buyhold_cumulative") * s.initial_capital,
        }
    )


def drawdown(
    df: DataFrame, value: str, name: str, keys: Sequence[str] = ("ticker",), order: str = "date"
) -> DataFrame:
    """Add the fall of ``value`` below its running maximum; the peak starts at the first row."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(value).over(so_far)
    return df.withColumn(name, (F.col(value) - peak) / peak)


def max_drawdown(column: str) -> Column:
    """Deepest drawdown as an aggregate; 0 for no rows."""
    return F.coalesce(F.min(column), F.lit(0.0))


def _strategy_totals(order: str, settings: Settings) -> list[Column]:
    """Aggregates over a ledger that has its drawdown columns."""
    return [
        (F.max_by("strategy_cumulative", order) - 1).alias("strategy_return"),
        sharpe("strategy_return", settings=settings).alias("strategy_sharpe"),
        max_drawdown("_strategy_fall").alias("strategy_max_drawdown"),
        F.max_by("strategy_value", order).alias("strategy_final_value"),
        (F.max_by("buyhold_cumulative", order) - 1).alias("buyhold_return"),
        sharpe("buyhold_return", settings=settings).alias("buyhold_sharpe"),
        max_drawdown("_buyhold_fall").alias("buyhold_max_drawdown"),
        F.max_by("buyhold_value", order).alias("buyhold_final_value"),
        F.sum("cost").alias("total_costs"),
    ]


def _compared(totals: DataFrame) -> DataFrame:
    excess = F.col("strategy_return") - F.col("buyhold_return")
    gain = F.coalesce(
        excess / F.nullif(F.abs("buyhold_return"), F.lit(0.0)) * 100, F.lit(0.0)
    )
    return totals.withColumns({"excess_return": excess, "improvement_pct": gain})


def _with_falls(days: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return drawdown(
        drawdown(days, "strategy_cumulative", "_strategy_fall", keys, order),
        "buyhold_cumulative", "_buyhold_fall", keys, order,
    )


def ledger_of(
    actual: DataFrame, predicted: DataFrame, keys: Sequence[str] = ("ticker",),
    order: str = "date", settings: Settings = DEFAULTS,
) -> DataFrame:
    """Ledger of returns in one table and predictions in another: the days both have."""
    return ledger(actual.join(predicted, [*keys, order]), keys, order, settings)


def strategy_summary(
    days: DataFrame, keys: Sequence[str] = ("ticker",), order: str = "date",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Totals of a ledger: return, Sharpe, drawdown and final value of both strategies,
    their difference, the number of trades and their cost."""
    return _compared(
        _with_falls(days, keys, order).groupBy(*keys).agg(
            *_strategy_totals(order, settings), F.count_if(F.col("cost") > 0).alias("n_trades")
        )
    )


def return_error(df: DataFrame, keys: Sequence[str] = (), actual="actual_return",
                 predicted="predicted_return") -> DataFrame:
    """Mean squared and mean absolute error of predicted returns."""
    gap = F.col(actual) - F.col(predicted)
    return df.groupBy(*keys).agg(F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"))


def _scores(df: DataFrame) -> DataFrame:
    """Classification scores from the four cell counts."""
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    return df.withColumns(
        {
            "directional_accuracy": _share(tp + tn, tp + tn + fp + fn),
            "precision": _share(tp, tp + fp),
            "recall": _share(tp, tp + fn),
            "f1_score": _share(2 * tp, 2 * tp + fp + fn),
        }
    )


def evaluate(
    df: DataFrame, key: str = "ticker", order: str = "date", settings: Settings = DEFAULTS
) -> DataFrame:
    """Every metric per ``key`` in one pass: the ledger's windows and a single group-by on the
    same partitioning give classification, return error and strategy totals together."""
    errors = []
    if "predicted_return" in df.columns:
        gap = F.col("actual_return") - F.col("predicted_return")
        errors = [F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae")]
    days = _with_falls(ledger(df, [key], order, settings), [key], order)
    return _compared(
        _scores(
            days.groupBy(key).agg(
                *[c.alias(n) for n, c in _counts("actual", "predicted").items()],
                *_strategy_totals(order, settings),
                F.count_if(F.col("cost") > 0).alias("n_trades"),
                *errors,
            )
        )
    )


def evaluate_universal(
    df: DataFrame, order: str = "date", settings: Settings = DEFAULTS
) -> DataFrame:
    """Pooled classification over all tickers plus an equal-weight portfolio's totals.

    The ledger is reduced to one row per calendar day (mean returns and costs, cell counts,
    growth factors), so the windows over the pooled book never see more than the calendar.
    ``chained_*`` compounds every ticker's every day end to end, as an order-free product; its
    ``_log`` twin sums logarithms of absolute growth and cannot overflow. ``mse`` and ``mae`` pool the
    errors of predicted returns over all rows (null without such a column).
    """
    gap = (
        F.col("actual_return") - F.col("predicted_return") if "predicted_return" in df.columns
        else F.lit(None).cast("double")
    )
    log_growth = lambda name: F.sum(F.ln(F.abs(1 + F.col(name))))
    counts = _counts("actual", "predicted")
    book = ledger(df, order=order, settings=settings).groupBy(order).agg(
        F.avg("strategy_return").alias("strategy_return"),
        F.avg("buyhold_return").alias("buyhold_return"),
        F.avg("cost").alias("cost"),
        F.product(1 + F.col("strategy_return")).alias("_strategy_factor"),
        F.product(1 + F.col("buyhold_return")).alias("_buyhold_factor"),
        log_growth("strategy_return").alias("_strategy_log"),
        log_growth("buyhold_return").alias("_buyhold_log"),
        F.sum(gap * gap).alias("_squares"), F.sum(F.abs(gap)).alias("_gaps"),
        F.count(gap).alias("_compared"),
        *[c.alias(n) for n, c in counts.items()],
    ).withColumn("ticker", F.lit(UNIVERSAL))
    so_far = Window.partitionBy("ticker").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    grown = book.withColumns(
        {
            "strategy_cumulative": F.product(1 + F.col("strategy_return")).over(so_far),
            "buyhold_cumulative": F.product(1 + F.col("buyhold_return")).over(so_far),
        }
    ).withColumns(
        {
            "strategy_value": F.col("strategy_cumulative") * settings.initial_capital,
            "buyhold_value": F.col("buyhold_cumulative") * settings.initial_capital,
        }
    )
    return _compared(
        _scores(
            _with_falls(grown, ["ticker"], order).groupBy("ticker").agg(
                *[F.sum(n).alias(n) for n in counts],
                *_strategy_totals(order, settings),
                F.count_if(F.col("cost") > 0).alias("n_trades"),
                (F.product("_strategy_factor") - 1).alias("chained_strategy_return"),
                (F.product("_buyhold_factor") - 1).alias("chained_buyhold_return"),
                F.sum("_strategy_log").alias("chained_strategy_log"),
                F.sum("_buyhold_log").alias("chained_buyhold_log"),
                F.try_divide(F.sum("_squares"), F.sum("_compared")).alias("mse"),
                F.try_divide(F.sum("_gaps"), F.sum("_compared")).alias("mae"),
            )
        )
    )


# Columns of the stored evaluation summary.
SUMMARY_COLUMNS = (
    "ticker", "directional_accuracy", "f1_score", "strategy_sharpe", "strategy_return",
    "buyhold_return", "excess_return",
)


def summary_table(df: DataFrame, order: str = "date", settings: Settings = DEFAULTS) -> DataFrame:
    """Six metrics, one row per ticker plus the universal row.

    Both halves read the predictions, so these (one row per ticker and day) are written once.
    """
    df = written(df, "predictions")
    return evaluate(df, order=order, settings=settings).select(*SUMMARY_COLUMNS).unionByName(
        evaluate_universal(df, order, settings).select(*SUMMARY_COLUMNS)
    )
