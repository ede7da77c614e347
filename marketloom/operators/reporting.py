"""Reporting queries: alerts, article series, feeds, chart windows, symbols, currencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.evaluation import UNIVERSAL
from marketloom.operators.indicators import add_indicators
from marketloom.operators.ordering import position_in_key
from marketloom.settings import DEFAULTS, POPULAR_TICKERS, Settings
from marketloom.workspace import written

# Currency codes and the symbols shown for them.
CURRENCY_SYMBOLS = {
    "USD": "$", "INR": "₹", "GBP": "£", "EUR": "€", "JPY": "¥",
    "CNY": "¥", "KRW": "₩", "HKD": "HK$", "CAD": "C$", "AUD": "A$",
    "SGD": "S$", "CHF": "CHF ", "SEK": "kr", "NOK": "kr", "DKK": "kr",
    "NZD": "NZ$", "ZAR": "R", "BRL": "R$", "MXN": "MX$", "TWD": "NT$",
    "THB": "฿", "IDR": "Rp", "MYR": "RM", "PHP": "₱", "TRY": "₺",
    "RUB": "₽", "PLN": "zł", "ILS": "₪", "AED": "د.إ", "SAR": "﷼",
    "PKR": "₨", "BDT": "৳", "LKR": "Rs", "NGN": "₦", "EGP": "E£",
    "VND": "₫", "CLP": "CLP$", "COP": "COL$", "PEN": "S/.",
    "ARS": "AR$", "CZK": "Kč", "HUF": "Ft", "RON": "lei",
}


def alert_name(total: Column, average: Column, negative: Column, settings: Settings = DEFAULTS):
    """The first alert that applies, else null."""
    s = settings
    return (
        F.when(F.coalesce(total, F.lit(0)) == 0, "NO_NEWS")
        .when(average < -s.alert_average, "STRONG_NEG")
        .when(average > s.alert_average, "STRONG_POS")
        .when(negative > total * s.alert_negative_share, "MAJORITY_NEG")
    )


def sentiment_alerts(
    requested: DataFrame, scored: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """One row per requested ticker: counts, average and its alert. News is pre-aggregated."""
    totals = scored.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("total"),
        F.avg("sentiment_score").alias("average"),
        F.count_if(F.col("label") == "positive").alias("positive"),
        F.count_if(F.col("label") == "negative").alias("negative"),
    )
    joined = requested.select("ticker").join(totals, "ticker", "left")
    alert = alert_name(F.col("total"), F.col("average"), F.col("negative"), settings)
    return joined.withColumn("alert", alert).fillna(0, ["total", "positive", "negative"])


def article_series(scored: DataFrame, tie_break: Sequence[str]) -> DataFrame:
    """1-based position of every article within its ticker, newest first, any ticker size.

    The articles are written once first: numbering samples its input, and scores are costly.
    """
    scored = written(scored, "articles")
    order = [F.col("date").desc_nulls_last(), *[F.col(c) for c in tie_break]]
    return position_in_key(scored, ["ticker"], order, "_position").withColumn(
        "position", F.col("_position") + 1
    ).drop("_position")


def headline_feed(
    scored: DataFrame, tie_break: Sequence[str], ticker: str | None = None, limit: int = 25
) -> DataFrame:
    """The first ``limit`` headlines, newest first, with a short time label; a top-k, not a sort."""
    rows = scored if ticker is None else scored.filter(F.col("ticker") == ticker)
    order = [F.col("date").desc_nulls_last(), *[F.col(c) for c in tie_break]]
    return rows.orderBy(*order).limit(limit).withColumn(
        "shown_date", F.coalesce(F.date_format("date", "MMM dd, HH:mm"), F.lit(""))
    )


def _recent(bars: DataFrame, days: int) -> DataFrame:
    newest = F.max("date").over(Window.partitionBy("ticker"))
    return bars.withColumn("_newest", newest).filter(
        F.col("date") >= F.date_sub("_newest", days)
    ).drop("_newest")


def chart_window(
    bars: DataFrame, days: int = DEFAULTS.chart_days, filter_first: bool = False
) -> DataFrame:
    """Bars with indicators for the last ``days`` days of each ticker.

    By default indicators see the whole history; ``filter_first`` cuts first, which leaves the
    warm-up rows of the window without indicators.
    """
    if filter_first:
        return add_indicators(_recent(bars, days))
    return _recent(add_indicators(bars), days)


def chart_marks(indicators: DataFrame) -> DataFrame:
    """Colours and reference lines of the chart as columns."""
    return indicators.withColumns(
        {
            "volume_is_up": F.col("close") >= F.col("open"),
            "hist_is_up": F.coalesce(F.col("macd_hist") >= 0, F.lit(False)),
            "rsi_zone": F.when(F.col("rsi") > 70, "overbought")
            .when(F.col("rsi") < 30, "oversold"),
        }
    )


def latest_metrics(indicators: DataFrame) -> DataFrame:
    """Last close, RSI, MACD, ATR and %B per ticker: one partial aggregate."""
    names = ("close", "rsi", "macd", "atr", "bb_pct")
    return indicators.groupBy("ticker").agg(
        F.max_by(F.struct("date", *names), "date").alias("_last")
    ).select("ticker", "_last.*")


def strategy_report(summary: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Returns in percent and the Sharpe target check per ticker, without the universal row."""
    return summary.filter(F.col("ticker") != UNIVERSAL).select(
        "ticker",
        (F.col("strategy_return") * 100).alias("strategy_pct"),
        (F.col("buyhold_return") * 100).alias("buyhold_pct"),
        "strategy_sharpe",
        (F.col("strategy_sharpe") >= settings.sharpe_target).alias("meets_target"),
    )


# Names that every open text is compared with directly; more of them meet on grams.
FEW_NAMES = 256


def _grams(text: Column, size: int) -> Column:
    """The runs of ``size`` characters of a text padded at both ends, each with its occurrence number."""
    pad = F.lit("\u0000" * (size - 1))
    padded = F.concat(pad, text, pad)
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(padded) - size + 1, F.lit(1))),
        lambda i: F.substring(padded, i, F.lit(size)),
    )
    sorted_ = F.array_sort(runs)
    return F.transform(
        sorted_, lambda run, i: F.concat(run, F.lit("\u0001"), (i - F.array_position(sorted_, run) + 1).cast("string"))
    )


def _by_rarity(texts: DataFrame, names: DataFrame, size: int) -> DataFrame:
    """``text, grams`` of every row of ``texts``, with the grams that fewest names hold first."""
    def exploded(of: DataFrame) -> DataFrame:
        return of.select("text", F.explode(_grams(F.col("text"), size)).alias("gram"))

    counts = exploded(names).groupBy("gram").agg(F.count("*").alias("held"))
    return exploded(texts).join(counts, "gram", "left").groupBy("text").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram"))).alias("grams")
    )


def _within(asked: DataFrame, names: DataFrame, size: int, radius: int) -> DataFrame:
    """``text, distance, symbol`` of the nearest name within ``radius`` edits, where there is one.

    An edit touches at most ``size`` grams, so of two texts ``radius`` edits apart that are long enough to
    share a gram at all, the ``size * radius + 1`` rarest grams of each have one in common.
    """
    def prefixed(of: DataFrame, *more: str) -> DataFrame:
        first = F.slice("grams", 1, size * radius + 1)
        return of.select("text", *more, F.explode(F.transform(first, lambda g: g["gram"])).alias("gram"))

    others = prefixed(names, "symbol").withColumnRenamed("text", "name")
    close = F.abs(F.length("text") - F.length("name")) <= radius
    distance = F.levenshtein(F.col("text"), F.col("name"), radius)
    return (
        prefixed(asked).join(others, "gram").filter(close).select("text", "name", "symbol").distinct()
        .withColumn("distance", distance).filter("distance >= 0")
        .groupBy("text").agg(F.min(F.struct("distance", "symbol")).alias("best"))
        .select("text", "best.distance", "best.symbol")
    )


def nearest_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``text, distance, symbol``: the name with the least edit distance to each ``text``.

    ``names`` has ``symbol`` and ``name``. A text is compared with each of at most ``FEW_NAMES`` names;
    among more of them the radius doubles from 0 on; what has a name within it
    leaves, and since all names within the radius were compared, its nearest is exact. Texts and names meet
    on their rarest grams: pairs of characters while the text is longer than twice the radius,
    then single ones. A name without any character of the text is as far as the longer of the
    two, which bounds the search and settles it. Ties go to the lower symbol.
    """
    names = written(names.groupBy(F.col("name").alias("text")).agg(F.min("symbol").alias("symbol")), "names")
    open_ = written(texts.select("text").distinct(), "texts")
    found = written(open_.join(names, "text").select("text", F.lit(0).alias("distance"), "symbol"), "nearest")
    lengths = names.groupBy(F.length("text").alias("size")).agg(F.min("symbol").alias("symbol"))
    shortest = lengths.agg(F.min("size")).first()[0]
    if shortest is None:
        return found
    open_ = written(open_.join(found, "text", "left_anti"), "texts")
    if names.limit(FEW_NAMES + 1).count() <= FEW_NAMES:
        few = names.select(F.col("text").alias("name"), "symbol")
        best = F.min(F.struct(F.levenshtein(F.col("text"), F.col("name")).alias("distance"), "symbol"))
        near = open_.crossJoin(few).groupBy("text").agg(best.alias("best"))
        return found.unionByName(near.select("text", "best.distance", "best.symbol"))
    by_gram = {}
    radius, size_of = 1, F.length("text")
    while (left := open_.agg(F.max(size_of).alias("longest"), F.min(size_of).alias("shortest")).first())["longest"]:
        near = None
        for size, some in ((2, left["longest"] >= 2 * radius), (1, left["shortest"] < 2 * radius)):
            if not some:
                continue
            if size not in by_gram:
                by_gram[size] = [written(rows, "grams") for rows in (
                    _by_rarity(names, names, size).join(names, "text"), _by_rarity(open_, names, size)
                )]
            known, asked = by_gram[size]
            here = size_of >= 2 * radius if size == 2 else size_of < 2 * radius
            here = _within(asked.join(open_, "text", "left_semi").filter(here), known, size, radius)
            near = here if near is None else near.unionByName(here)
        if max(left["shortest"], shortest) <= radius:  # every name no longer than the reach is at most that far
            reach = F.greatest(size_of, F.lit(shortest))
            last = open_.filter(reach <= radius).withColumn("distance", reach).join(
                lengths, F.col("size") <= F.col("distance")
            ).groupBy("text", "distance").agg(F.min("symbol").alias("symbol"))
            near = near.unionByName(last).groupBy("text").agg(
                F.min(F.struct("distance", "symbol")).alias("best")
            ).select("text", "best.distance", "best.symbol")
        near = written(near, "nearest")
        found = found.unionByName(near)
        open_ = written(open_.join(near, "text", "left_anti"), "texts")
        radius *= 2
    return found


def resolve_symbols(inputs: DataFrame, symbols: DataFrame, max_distance: int | None = None) -> DataFrame:
    """Symbol of each free-text ``input``: that of the nearest name or symbol, else the text in upper case.

    Case and outer spaces do not count. The nearest is found however far it is (``nearest_names``); with
    ``max_distance`` only within so many edits. Blank and null inputs, and all of them if there are
    no names, have no nearest. Repeated inputs are looked up once. Ties go to the lower symbol.
    """
    text = F.lower(F.trim("input"))
    names = symbols.select("symbol", F.explode(F.array(F.lower("name"), F.lower("symbol"))).alias("name"))
    nearest = nearest_names(
        inputs.select(text.alias("text")).filter("text <> ''"), names.filter("name <> ''")
    )
    if max_distance is not None:
        nearest = nearest.filter(F.col("distance") <= max_distance)
    return inputs.withColumn("_text", text).join(
        nearest.select(F.col("text").alias("_text"), "symbol"), "_text", "left"
    ).select(*inputs.columns, F.coalesce("symbol", F.upper(F.trim("input"))).alias("symbol"))


def display_name(ticker: Column, name: Column) -> Column:
    """``Name (TICKER)``, or the ticker alone if the name is unknown or the same."""
    named = name.isNotNull() & (name != "") & (name != ticker)
    return F.when(named, F.concat(name, F.lit(" ("), ticker, F.lit(")"))).otherwise(ticker)


def currency_symbol(code: Column) -> Column:
    """Symbol of a currency code; a missing code means dollars, an unknown one stands for itself.

    The 43 symbols are a literal map in the plan: no join.
    """
    known = F.create_map(*[F.lit(x) for pair in CURRENCY_SYMBOLS.items() for x in pair])
    given = F.coalesce(F.nullif(code, F.lit("")), F.lit("USD"))
    return F.coalesce(
        F.try_element_at(known, F.upper(given)), F.concat(given, F.lit(" "))
    )


def watchlist(own: Column, popular: Sequence[str] = POPULAR_TICKERS) -> Column:
    """The user's own tickers, then the popular ones, each once."""
    return F.array_distinct(
        F.concat(F.coalesce(own, F.array().cast("array<string>")),
                 F.array(*[F.lit(t) for t in popular]))
    )
