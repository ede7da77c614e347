"""Chronological splits and sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.features import MODEL_COLUMNS, feature_columns
from marketloom.operators.ordering import numbered
from marketloom.settings import DEFAULTS, Settings


def _label(position: Column, n: Column, settings: Settings) -> Column:
    """Split of a 0-based position; the cuts are floors in double precision."""
    train = F.floor(n.cast("double") * F.lit(settings.train_split))
    val = F.floor(n.cast("double") * F.lit(settings.train_split + settings.val_split))
    return F.when(position < train, "train").when(position < val, "val").otherwise("test")


def split_all(df: DataFrame, order: Sequence[str], settings: Settings = DEFAULTS) -> DataFrame:
    """One chronological split of a whole table of any size, without a single-task sort."""
    ranked = numbered(df, order, "_position")
    total = ranked.agg(F.count(F.lit(1))).scalar()
    return ranked.withColumn("_n", total).withColumn(
        "split", _label(F.col("_position"), F.col("_n"), settings)
    ).drop("_position", "_n")


def with_position(df: DataFrame, key: str = "ticker", order: str = "date") -> DataFrame:
    """0-based position and row count per ticker of daily rows, in one window partition."""
    return df.withColumns(
        {
            "position": F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1,
            "n": F.count(F.lit(1)).over(
                Window.partitionBy(key).orderBy(order).rowsBetween(
                    Window.unboundedPreceding, Window.unboundedFollowing
                )
            ),
        }
    )


def split_per_ticker(
    df: DataFrame, key: str = "ticker", order: str = "date", settings: Settings = DEFAULTS
) -> DataFrame:
    """Chronological split inside each ticker."""
    placed = with_position(df, key, order)
    return placed.withColumn("split", _label(F.col("position"), F.col("n"), settings)).drop(
        "position", "n"
    )


def test_slice(
    df: DataFrame, key: str = "ticker", order: str = "date", settings: Settings = DEFAULTS
) -> DataFrame:
    """Last rows of each ticker, from floor(0.85 n); tickers with no full window are skipped.

    ``position`` restarts at 0 inside the slice.
    """
    start = F.floor(
        F.col("n").cast("double") * F.lit(settings.train_split + settings.val_split)
    )
    placed = with_position(df, key, order).withColumn("_start", start)
    kept = (F.col("position") >= F.col("_start")) & (
        F.col("n") - F.col("_start") >= settings.seq_len + 1
    )
    return (
        placed.filter(kept)
        .withColumn("position", (F.col("position") - F.col("_start")).cast("int"))
        .drop("_start", "n")
    )


def sequences(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = ("ticker",),
    order: str = "date",
    seq_len: int = DEFAULTS.seq_len,
) -> DataFrame:
    """One sample per row with ``seq_len`` rows before it: their features and this row's targets.

    The sample holds rows t - seq_len .. t - 1, so its size is fixed. Missing target columns
    count as 0.
    """
    features = feature_columns(df, columns or MODEL_COLUMNS)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(-seq_len, -1)
    row = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    targets = [
        (F.col(c) if c in df.columns else F.lit(0)).cast(kind).alias(c)
        for c, kind in (("target_direction", "int"), ("target_return", "double"))
    ]
    carried = ["split"] if "split" in df.columns and "split" not in keys else []
    return (
        df.withColumn("sequence", F.collect_list(row).over(before))
        .filter(F.size("sequence") == seq_len)
        .select(*keys, order, *carried, "sequence", *targets)
    )
