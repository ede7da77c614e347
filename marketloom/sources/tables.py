"""Stored results: vectors with their metadata, scaler parameters, evaluation summaries."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, append: bool = False) -> None:
    """Store a table as Parquet; vectors and metadata share one row, so they cannot drift apart."""
    df.write.mode("append" if append else "overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Scan a stored table; a missing one raises."""
    return spark.read.parquet(path)


def read_scaler(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored scaler parameters, or None with a warning if there are none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        warnings.warn(f"no scaler at {path}; fit one first", stacklevel=2)
        return None


_SUMMARY_TYPES = (
    "ticker string, directional_accuracy double, f1_score double, strategy_sharpe double, "
    "strategy_return double, buyhold_return double, excess_return double"
)


def write_summary(summary: DataFrame, path: str) -> None:
    """Store the evaluation summary as CSV with a header."""
    summary.write.mode("overwrite").option("header", True).csv(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored evaluation summary back for reporting."""
    return spark.read.option("header", True).schema(_SUMMARY_TYPES).csv(path)
