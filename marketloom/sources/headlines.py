"""Headline files: scanning, column names, defaults, cleaning and multi-file union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.dates import instant
from marketloom.operators.ordering import keep_first, nulls_last, packed
from marketloom.settings import DEFAULTS

# Accepted column names per role, most specific first.
HEADLINE_NAMES = ("headline", "title", "text", "news", "description", "content")
DATE_NAMES = ("date", "publish_date", "timestamp", "published", "datetime", "time")
TICKER_NAMES = ("ticker", "stock", "symbol", "company")
SOURCE_NAMES = ("source", "publisher", "provider")
# A header cell with one of these words is data, so the file has no header.
SENTIMENT_WORDS = ("positive", "negative", "neutral")
DEFAULT_TICKER = "UNKNOWN"
DEFAULT_SOURCE = "kaggle"


#: Column with the place of a row among the scanned files, and the bits of its three parts.
PLACE = "_place"
_FILE_BITS, _BLOCK_BITS, _LINE_BITS = 20, 50, 33


def _plain_path(path: Column) -> Column:
    """A path with one slash behind its scheme: the listing and the rows spell it differently."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def _placed(rows: DataFrame) -> DataFrame:
    """Add each row's place in the order of the files: file by path, block in it, line in that.

    A block is read by one task from its start, so the task's row numbers order its lines. The paths
    are those of the scan's own listing.
    """
    rows = rows.select(
        "*", _plain_path(F.col("_metadata.file_path")).alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _LINE_BITS) - 1)).alias("_line"),
    )
    files = rows.sparkSession.createDataFrame(
        [(path, at) for at, path in enumerate(sorted(rows.inputFiles()))], "_path string, _number bigint"
    ).withColumn("_path", _plain_path(F.col("_path")))
    rows = rows.join(files, "_path", "left")
    place = packed(rows, ["_number", "_block", "_line"], [_FILE_BITS, _BLOCK_BITS, _LINE_BITS])
    return rows.withColumn(PLACE, F.coalesce(place, F.lit(0).cast("decimal(38,0)"))).drop("_path", "_block", "_line", "_number")


def scan_csv(
    spark: SparkSession, path: str, encoding: str = "ISO-8859-1", multi_line: bool = False, placed: bool = False,
) -> DataFrame:
    """Scan a headline CSV, with or without a header line; a missing path raises.

    Set ``multi_line`` for files with line breaks inside quotes; such files are not splittable.
    ``placed`` adds the column ``PLACE``, which sorts the rows as the files hold them.
    """
    reader = (
        spark.read.option("encoding", encoding).option("multiLine", multi_line)
        .option("escape", '"')
    )
    rows = reader.option("header", True).csv(path)
    if any(c.strip().lower() in SENTIMENT_WORDS for c in rows.columns):
        rows = reader.option("header", False).csv(path)
        names = ["sentiment", "headline"] + [f"col_{i}" for i in range(2, len(rows.columns))]
        rows = rows.withColumnsRenamed(dict(zip(rows.columns, names)))
    return _placed(rows) if placed else rows


def find_column(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """The column whose trimmed, lower-case name is the first match in ``names``."""
    present = {c.strip().lower(): c for c in columns}
    return next((present[n] for n in names if n in present), None)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _stamp(df: DataFrame, name: str) -> Column:
    """A date column as a UTC timestamp; one that is a date or time already is only cast."""
    if dict(df.dtypes)[name] == "string":
        return instant(_quoted(name))
    return _quoted(name).cast("timestamp_ntz")


def standardize(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Headline, date, ticker, source under their standard names, with defaults for the last
    three. Dates are read in all forms of ``instant``; what names no day becomes null. ``keep`` passes further columns through."""
    headline = find_column(df.columns, HEADLINE_NAMES)
    if headline is None:
        raise ValueError(f"no headline column among {df.columns}; expected one of {HEADLINE_NAMES}")
    date = find_column(df.columns, DATE_NAMES)
    ticker = find_column(df.columns, TICKER_NAMES)
    source = find_column(df.columns, SOURCE_NAMES)
    stamp = (
        _stamp(df, date) if date
        else F.lit(None).cast("timestamp_ntz")
    )
    return df.select(
        *[_quoted(c) for c in keep],
        _quoted(headline).cast("string").alias("headline"),
        stamp.alias("date"),
        (_quoted(ticker).cast("string") if ticker else F.lit(DEFAULT_TICKER)).alias("ticker"),
        (_quoted(source).cast("string") if source else F.lit(DEFAULT_SOURCE)).alias("source"),
    )


def basic_clean(
    df: DataFrame, order: Sequence[Column], min_length: int = DEFAULTS.min_headline_length
) -> DataFrame:
    """Drop null and short headlines and exact copies. The first copy by ``order`` stays."""
    long_enough = df.filter(F.length("headline") >= min_length)
    return keep_first(long_enough, ["headline"], order)


def by_date(df: DataFrame) -> DataFrame:
    """Sorted by date, undated rows last."""
    return df.orderBy(F.col("date").asc_nulls_last())


def load(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Scan, standardise and clean one headline file; of copies the first in the file stays."""
    rows = standardize(scan_csv(spark, path, multi_line=multi_line, placed=True), keep=[PLACE])
    return by_date(basic_clean(rows, [F.col(PLACE)]).drop(PLACE))


def union_files(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of standardised files; copies across files collapse and the earlier file wins.

    Within a file the first by ``PLACE`` stays, or the earliest-dated one where that column is missing.
    """
    if not parts:
        raise ValueError("none of the headline files could be loaded")
    if all(PLACE in rows.columns for rows in parts):
        step = F.lit(str(1 << (_FILE_BITS + _BLOCK_BITS + _LINE_BITS))).cast("decimal(38,0)")
        parts = [
            rows.withColumn(PLACE, F.coalesce(
                (F.lit(number).cast("decimal(38,0)") * step + F.col(PLACE)).cast("decimal(38,0)"), F.col(PLACE)
            )) for number, rows in enumerate(parts)
        ]
        union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return basic_clean(union, [F.col(PLACE)]).drop(PLACE)
    tagged = [rows.withColumn("_file", F.lit(number)) for number, rows in enumerate(parts)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    order = [F.col("_file"), *nulls_last(F.col("date")), F.col("ticker"), F.col("source")]
    return basic_clean(union, order).drop("_file")


def load_many(spark: SparkSession, paths: Sequence[str], multi_line: bool = False) -> DataFrame:
    """Union of several files; unreadable files are skipped, none readable raises."""
    parts = []
    for path in paths:
        try:
            parts.append(standardize(scan_csv(spark, path, multi_line=multi_line, placed=True), keep=[PLACE]))
        except (AnalysisException, ValueError):
            continue
    return union_files(parts)
