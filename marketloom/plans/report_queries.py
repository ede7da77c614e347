"""Registered queries behind the dashboard, and the scans and sinks of bars and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import evaluation as ev
from marketloom.operators import reporting as rp
from marketloom.operators.features import apply_scaler, fit_scaler
from marketloom.operators.splits import split_per_ticker
from marketloom.plans.evaluation_queries import SUMMARY_SQL, predictions
from marketloom.plans.feature_queries import SCALER_SQL, features
from marketloom.plans.price_queries import INDICATORS_SQL, indicators, rounded, rounded_sql
from marketloom.plans.registry import query
from marketloom.plans.sentiment_queries import SCORED_SQL, scored
from marketloom.plans.tables import (
    ARTICLES_SQL, BARS_SQL, FEED_SQL, articles, bars, feed_entries, table,
)
from marketloom.plans.text_queries import html_text_sql
from marketloom.settings import POPULAR_TICKERS
from marketloom.sources import bars as bar_source
from marketloom.sources import feeds, tables as sinks
from marketloom.workspace import new_path, written

_OHLCV = "open, high, low, close, volume"


@query(
    "a7_bars_in_range",
    f"WITH {BARS_SQL} SELECT ticker, date, {_OHLCV} FROM bars "
    "WHERE date >= DATE '1998-01-01' AND date < DATE '2000-01-01'",
)
def a7(spark, sf_dir):
    return bar_source.in_range(bars(spark, sf_dir), "1998-01-01", "2000-01-01")


@query(
    "a8_freshness",
    f"WITH {BARS_SQL} SELECT ticker, max(date) AS last_date, "
    "max(date) >= DATE '2001-11-04' - 1 AS is_fresh FROM bars GROUP BY ticker",
)
def a8(spark, sf_dir):
    return bar_source.freshness(bars(spark, sf_dir), F.lit("2001-11-04").cast("date"))


@query("a9_flatten_names", f"WITH {BARS_SQL} SELECT ticker, date, {_OHLCV} FROM bars")
def a9(spark, sf_dir):
    """Two-level headers, as some downloads have them, flattened and checked."""
    two_level = bars(spark, sf_dir).toDF(
        "('Ticker', '')", "('Date', '')", "('Open', 'X')", "('High', 'X')", "('Low', 'X')",
        "('Close', 'X')", "('Volume', 'X')",
    )
    flat = bar_source.flatten_names(two_level)
    missing = bar_source.missing_columns(flat)
    if missing:
        raise ValueError(f"bars lack {missing}")
    return flat


@query(
    "a10_several_tickers",
    f"WITH {BARS_SQL} SELECT ticker, date, {_OHLCV} FROM bars "
    "WHERE ticker IN ('Brand#3', 'Brand#7', 'Brand#21')",
)
def a10(spark, sf_dir):
    return bar_source.for_tickers(
        bars(spark, sf_dir), ["Brand#3", "Brand#7", "Brand#21", "Brand#none"]
    )


@query(
    "a11_latest_price",
    f"""WITH {BARS_SQL} SELECT ticker, max(close) FILTER (WHERE r = 1) AS last_price,
    max(close) FILTER (WHERE r = 2) AS previous_close FROM (SELECT *, row_number() OVER
    (PARTITION BY ticker ORDER BY date DESC) AS r FROM bars) GROUP BY ticker""",
)
def a11(spark, sf_dir):
    return bar_source.latest_price(bars(spark, sf_dir))


_PUBLISHED = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(page_id % 28 as int), 0, cast(page_id % 60 as int))"


@query(
    "a12_rss_ingest",
    f"""WITH {FEED_SQL} SELECT headline, CASE WHEN page_id % 10 <> 9 THEN
      TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 28 AS INTEGER)) + to_minutes(page_id % 60)
      END AS date, 'google_news' AS source, ticker, link AS url
    FROM (SELECT *, {html_text_sql('trim(title)')} AS headline FROM feed) WHERE headline <> ''""",
)
def a12(spark, sf_dir):
    """Pages landed as RSS files, then scanned; one date in ten cannot be read."""
    stamp = F.date_format(F.expr(_PUBLISHED), "EEE, dd MMM yyyy HH:mm:ss")
    items = feed_entries(spark, sf_dir).select(
        "title", "link",
        F.when(F.col("page_id") % 10 == 9, "yesterday")
        .otherwise(F.concat(stamp, F.lit(" GMT"))).alias("pubDate"),
        "ticker",
    )
    path = new_path(spark, "rss")
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return feeds.read_rss(spark, path, "google_news")


@query(
    "a12_feed_zones",
    f"""WITH {FEED_SQL} SELECT page_id % 2 AS kind, headline,
      TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 28 AS INTEGER)) + to_minutes(page_id % 60)
      AS date, link AS url
    FROM (SELECT *, {html_text_sql('trim(title)')} AS headline FROM feed) WHERE headline <> ''""",
)
def a12_zones(spark, sf_dir):
    """Even pages landed as RSS with the dates of many zones, odd ones as Atom entries."""
    entries = feed_entries(spark, sf_dir).withColumn("at", F.expr(_PUBLISHED))
    day = "d MMM yyyy HH:mm:ss"
    zone = F.col("page_id") % 6
    shown = (
        F.when(zone == 0, F.concat(F.date_format(F.expr("at - interval 5 hours"), day), F.lit(" -0500")))
        .when(zone == 2, F.concat(F.date_format(F.expr("at - interval 7 hours"), "EEE, " + day), F.lit(" PDT")))
        .otherwise(F.concat(F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    )
    rss = entries.filter("page_id % 2 = 0").select("title", "link", shown.alias("pubDate"), "ticker")
    atom = entries.filter("page_id % 2 = 1").select(
        F.struct(F.lit("html").alias("_type"), F.col("title").alias("_VALUE")).alias("title"),
        F.array(
            F.struct(F.lit("http://feed").alias("_href"), F.lit("self").alias("_rel")),
            F.struct(F.col("link").alias("_href"), F.lit(None).cast("string").alias("_rel")),
        ).alias("link"),
        F.concat(F.date_format(F.expr("at + interval 90 minutes"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30"))
        .alias("updated"), "ticker",
    )
    found = []
    for kind, rows in ((0, rss), (1, atom)):
        path = new_path(spark, "feed")
        rows.write.format("xml").option("rootTag", "channel").option(
            "rowTag", "entry" if kind else "item"
        ).save(path)
        found.append(feeds.read_rss(spark, path, "google_news").select(
            F.lit(kind).cast("bigint").alias("kind"), "headline", "date", "url"
        ))
    return found[0].unionByName(found[1])


@query(
    "a13_reddit_ingest",
    """SELECT trim(text) AS headline, TIMESTAMP '2024-01-01' + to_minutes(conv_id * 10 + turn)
      AS date, 'reddit_r/' || role AS source, 'Brand#' || CAST(conv_id % 25 + 1 AS VARCHAR)
      AS ticker, 'https://reddit.com/r/' || conv_id || '/' || turn AS url
    FROM conversations WHERE trim(text) <> ''""",
)
def a13(spark, sf_dir):
    """Conversations landed as listings of one role per conversation page, then scanned."""
    talk = table(spark, sf_dir, "conversations").withColumn("page", F.floor(F.col("turn") / 15))
    posts = F.struct(
        F.struct(
            F.col("text").alias("title"),
            (F.lit(1704067200.0) + (F.col("conv_id") * 10 + F.col("turn")) * 60)
            .alias("created_utc"),
            F.concat(F.lit("/r/"), "conv_id", F.lit("/"), "turn").alias("permalink"),
        ).alias("data")
    )
    # A listing page holds 15 posts, so the lists are short whatever the conversation's length.
    listings = talk.groupBy("conv_id", "page", F.col("role").alias("subreddit")).agg(
        F.struct(F.collect_list(posts).alias("children")).alias("data")
    ).select(
        F.concat(F.lit("Brand#"), (F.col("conv_id") % 25 + 1).cast("string")).alias("ticker"),
        "subreddit", "data",
    )
    path = new_path(spark, "reddit")
    listings.write.json(path)
    return feeds.read_reddit(spark, path)


@query(
    "a14_fallback_feed",
    """WITH entries AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host,
      CASE WHEN url LIKE 'https%' THEN 0 ELSE 1 END AS feed FROM pages)
    SELECT page_id, host, CAST(feed AS INTEGER) AS feed FROM (SELECT *, min(feed) OVER
    (PARTITION BY host) AS best FROM entries) WHERE feed = best""",
)
def a14(spark, sf_dir):
    entries = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("host"),
        F.when(F.col("url").startswith("https"), 0).otherwise(1).alias("feed"),
    )
    return feeds.first_feed_with_rows(entries, "host")


def _four_sources(spark, sf_dir):
    """Articles, feed titles, forum posts and stories with one schema."""
    brand = lambda n: F.concat(F.lit("Brand#"), (n % 25 + 1).cast("string"))
    wire = articles(spark, sf_dir).select(
        F.concat(F.lit("w"), "article_id").alias("id"), "date", "ticker",
        F.lit("yahoo_finance").alias("source"),
    )
    pages = feed_entries(spark, sf_dir).select(
        F.concat(F.lit("p"), "page_id").alias("id"),
        F.expr(_PUBLISHED).alias("date"), "ticker", F.lit("google_news").alias("source"),
    )
    forum = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"),
        F.lit(None).cast("timestamp_ntz").alias("date"), brand(F.col("conv_id")).alias("ticker"),
        F.lit("reddit").alias("source"),
    )
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.expr("timestamp_ntz'2024-01-05 00:00:00' + make_dt_interval(0, cast(doc_id % 100 as int))")
        .alias("date"), brand(F.col("doc_id")).alias("ticker"),
        F.lit("seeking_alpha").alias("source"),
    )
    return [wire, pages, forum, docs]


@query(
    "a16_newest_articles",
    f"""WITH {ARTICLES_SQL}, everything AS (
      SELECT 'w' || article_id AS id, date, ticker, 'yahoo_finance' AS source FROM articles
      UNION ALL SELECT 'p' || page_id, TIMESTAMP '2024-01-01'
        + to_days(CAST(page_id % 28 AS INTEGER)) + to_minutes(page_id % 60),
        'Brand#' || CAST(page_id % 25 + 1 AS VARCHAR), 'google_news' FROM pages
      UNION ALL SELECT 'c' || conv_id || '-' || turn, NULL,
        'Brand#' || CAST(conv_id % 25 + 1 AS VARCHAR), 'reddit' FROM conversations
      UNION ALL SELECT 'd' || doc_id, TIMESTAMP '2024-01-05' + to_hours(doc_id % 100),
        'Brand#' || CAST(doc_id % 25 + 1 AS VARCHAR), 'seeking_alpha' FROM documents)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ticker
      ORDER BY date DESC NULLS LAST, id) AS INTEGER) AS position FROM everything)
    WHERE position <= 500""",
)
def a16(spark, sf_dir):
    return feeds.newest_articles(_four_sources(spark, sf_dir), tie_break=["id"])


_COMPANIES_SQL = """
companies AS (SELECT p_brand AS ticker, min(p_name) AS company FROM part GROUP BY p_brand)"""


def companies(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("ticker")).agg(
        F.min("p_name").alias("company")
    )


@query(
    "a17_company_names",
    f"WITH {ARTICLES_SQL}, {_COMPANIES_SQL} SELECT article_id, ticker, company, "
    "coalesce(company, ticker) AS search_name FROM articles LEFT JOIN companies USING (ticker)",
)
def a17(spark, sf_dir):
    news = articles(spark, sf_dir).select("article_id", "ticker")
    return feeds.with_company(news, companies(spark, sf_dir))


@query(
    "a19_bar_sink",
    f"WITH {BARS_SQL} SELECT ticker, date, {_OHLCV} FROM bars WHERE ticker = 'Brand#5' "
    "AND date >= DATE '1999-01-01' AND date < DATE '2000-01-01'",
)
def a19(spark, sf_dir):
    """Bars stored by ticker, then one ticker's year scanned with pruning."""
    path = new_path(spark, "bars")
    bar_source.write_bars(bars(spark, sf_dir), path)
    stored = bar_source.read_bars(spark, path, ["Brand#5"], "1999-01-01", "2000-01-01")
    return stored.select("ticker", "date", "open", "high", "low", "close", "volume")


@query("a20_vector_sink", "SELECT vec_id, len(embedding) AS dims, label FROM embeddings")
def a20(spark, sf_dir):
    path = new_path(spark, "vectors")
    sinks.write_table(table(spark, sf_dir, "embeddings"), path)
    return sinks.read_table(spark, path).select(
        "vec_id", F.size("embedding").cast("bigint").alias("dims"), "label"
    )


@query(
    "a21_scaler_sink",
    f"WITH RECURSIVE {SCALER_SQL} SELECT ticker, date, "
    "round((rsi - (SELECT mean FROM scaler WHERE feature = 'rsi')) / "
    "(SELECT scale FROM scaler WHERE feature = 'rsi'), 4) AS rsi FROM split",
)
def a21(spark, sf_dir):
    """Scaler parameters stored after the fit, loaded again to transform."""
    path = new_path(spark, "scaler")
    labelled = written(split_per_ticker(features(spark, sf_dir)), "features")
    sinks.write_table(fit_scaler(labelled.filter(F.col("split") == "train")), path)
    return apply_scaler(labelled, sinks.read_scaler(spark, path)).select(
        "ticker", "date", *rounded("rsi")
    )


@query(
    "a22_summary_sink",
    f"WITH RECURSIVE {SUMMARY_SQL} SELECT ticker, {rounded_sql(*ev.SUMMARY_COLUMNS[1:])} "
    "FROM table_rows",
)
def a22(spark, sf_dir):
    path = new_path(spark, "summary")
    sinks.write_summary(ev.summary_table(predictions(spark, sf_dir)), path)
    return sinks.read_summary(spark, path).select("ticker", *rounded(*ev.SUMMARY_COLUMNS[1:]))


@query(
    "i1_sentiment_alerts",
    f"""WITH {ARTICLES_SQL}, asked AS (SELECT DISTINCT p_brand AS ticker FROM part
      UNION ALL SELECT r_name FROM region),
    totals AS (SELECT ticker, count(*) AS total, avg(sentiment_score) AS average,
      CAST(count_if(label = 'positive') AS BIGINT) AS positive,
      CAST(count_if(label = 'negative') AS BIGINT) AS negative FROM articles GROUP BY ticker)
    SELECT ticker, coalesce(total, 0) AS total, round(average, 6) AS average,
      coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative,
      CASE WHEN total IS NULL THEN 'NO_NEWS' WHEN average < -0.3 THEN 'STRONG_NEG'
        WHEN average > 0.3 THEN 'STRONG_POS' WHEN negative > total * 0.6 THEN 'MAJORITY_NEG' END
        AS alert FROM asked LEFT JOIN totals USING (ticker)""",
)
def i1(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    places = table(spark, sf_dir, "region").select(F.col("r_name").alias("ticker"))
    return rp.sentiment_alerts(asked.unionByName(places), articles(spark, sf_dir)).withColumn(
        "average", F.round("average", 6)
    )


@query(
    "i2_article_series",
    f"""WITH {SCORED_SQL} SELECT ticker, doc_id, row_number() OVER (PARTITION BY ticker
    ORDER BY date DESC NULLS LAST, doc_id) AS position, round(sentiment_score, 6)
    AS sentiment_score, label FROM scored""",
)
def i2(spark, sf_dir):
    news = scored(spark, sf_dir).select("ticker", "doc_id", "date", "sentiment_score", "label")
    return rp.article_series(news, ["doc_id"]).select(
        "ticker", "doc_id", "position", *rounded("sentiment_score", digits=6), "label"
    )


@query(
    "i3_headline_feed",
    f"""WITH {SCORED_SQL} SELECT doc_id, ticker, label, round(sentiment_score, 6)
      AS sentiment_score, headline, strftime(date, '%b %d, %H:%M') AS shown_date
    FROM scored ORDER BY date DESC NULLS LAST, doc_id LIMIT 25""",
)
def i3(spark, sf_dir):
    return rp.headline_feed(scored(spark, sf_dir), ["doc_id"]).select(
        "doc_id", "ticker", "label", *rounded("sentiment_score", digits=6), "headline",
        "shown_date",
    )


@query(
    "i4_chart_window",
    f"""WITH RECURSIVE {INDICATORS_SQL} SELECT ticker, date, close, {rounded_sql('rsi', 'macd')}
    FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS newest FROM indicators)
    WHERE date >= newest - 90""",
)
def i4(spark, sf_dir):
    return rp.chart_window(bars(spark, sf_dir)).select(
        "ticker", "date", "close", *rounded("rsi", "macd")
    )


@query(
    "i5_chart_colours",
    f"WITH RECURSIVE {INDICATORS_SQL} SELECT ticker, date, close >= open AS volume_is_up, "
    "coalesce(macd_hist >= 0, false) AS hist_is_up FROM indicators",
)
def i5(spark, sf_dir):
    return rp.chart_marks(indicators(spark, sf_dir)).select(
        "ticker", "date", "volume_is_up", "hist_is_up"
    )


@query(
    "i6_rsi_zone",
    f"WITH RECURSIVE {INDICATORS_SQL} SELECT ticker, date, CASE WHEN rsi > 70 THEN 'overbought' "
    "WHEN rsi < 30 THEN 'oversold' END AS rsi_zone FROM indicators",
)
def i6(spark, sf_dir):
    return rp.chart_marks(indicators(spark, sf_dir)).select("ticker", "date", "rsi_zone")


@query(
    "i7_latest_metrics",
    f"""WITH RECURSIVE {INDICATORS_SQL} SELECT ticker, date, close,
    {rounded_sql('rsi', 'macd', 'atr', 'bb_pct')} FROM indicators WHERE next_date IS NULL""",
)
def i7(spark, sf_dir):
    return rp.latest_metrics(indicators(spark, sf_dir)).select(
        "ticker", "date", "close", *rounded("rsi", "macd", "atr", "bb_pct")
    )


@query(
    "i8_strategy_report",
    f"""WITH RECURSIVE {SUMMARY_SQL} SELECT ticker,
      round(strategy_return * 100, 4) AS strategy_pct, round(buyhold_return * 100, 4)
      AS buyhold_pct, round(strategy_sharpe, 4) AS strategy_sharpe,
      strategy_sharpe >= 1.2 AS meets_target FROM table_rows WHERE ticker <> '_UNIVERSAL'""",
)
def i8(spark, sf_dir):
    return rp.strategy_report(ev.summary_table(predictions(spark, sf_dir))).select(
        "ticker", *rounded("strategy_pct", "buyhold_pct", "strategy_sharpe"), "meets_target"
    )


_ASKED = (
    "CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) || 'x' "
    "WHEN 2 THEN ' ' || substring(n_name, 2) ELSE c_name END"
)


@query(
    "i9_symbol_lookup",
    f"""WITH symbols AS (SELECT 'N-' || n_nationkey AS symbol, n_name AS name FROM nation),
    names AS (SELECT symbol, lower(name) AS name FROM symbols
              UNION SELECT symbol, lower(symbol) FROM symbols),
    asked AS (SELECT c_custkey, {_ASKED} AS input FROM customer JOIN nation
              ON n_nationkey = c_nationkey),
    near AS (SELECT input, symbol, levenshtein(lower(trim(input)), name) AS d
             FROM (SELECT DISTINCT input FROM asked WHERE trim(input) <> '') CROSS JOIN names),
    best AS (SELECT input, symbol FROM (SELECT *, row_number() OVER (PARTITION BY input
             ORDER BY d, symbol) AS r FROM near) WHERE r = 1)
    SELECT c_custkey, input, coalesce(symbol, upper(trim(input))) AS symbol
    FROM asked LEFT JOIN best USING (input)""",
)
def i9(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    symbols = nations.select(
        F.concat(F.lit("N-"), "n_nationkey").alias("symbol"), F.col("n_name").alias("name")
    )
    asked = table(spark, sf_dir, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.expr(_ASKED).alias("input"))
    return rp.resolve_symbols(asked, symbols)


@query(
    "i10_display_name",
    f"WITH {_COMPANIES_SQL} SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE company "
    "|| ' (' || p_brand || ')' END AS shown FROM part JOIN companies ON ticker = p_brand",
)
def i10(spark, sf_dir):
    named = table(spark, sf_dir, "part").join(
        companies(spark, sf_dir), F.col("ticker") == F.col("p_brand")
    )
    name = F.when(F.col("p_size") <= 25, F.col("company"))
    return named.select("p_partkey", rp.display_name(F.col("p_brand"), name).alias("shown"))


_CODES = [*rp.CURRENCY_SYMBOLS, "XAU"]
_CODES_SQL = "[" + ", ".join(f"'{c}'" for c in _CODES) + "]"
_SYMBOLS_SQL = ", ".join(f"('{k}', '{v}')" for k, v in rp.CURRENCY_SYMBOLS.items())


@query(
    "i11_currency_symbol",
    f"""WITH known(code, shown) AS (VALUES {_SYMBOLS_SQL}),
    asked AS (SELECT s_suppkey, CASE WHEN s_nationkey > 0
      THEN lower({_CODES_SQL}[CAST(s_suppkey % {len(_CODES)} + 1 AS INTEGER)]) END AS code
      FROM supplier)
    SELECT s_suppkey, coalesce(shown, asked.code || ' ') AS shown FROM asked LEFT JOIN known
    ON known.code = upper(coalesce(asked.code, 'USD'))""",
)
def i11(spark, sf_dir):
    codes = F.array(*[F.lit(c) for c in _CODES])
    code = F.lower(F.element_at(codes, (F.col("s_suppkey") % len(_CODES) + 1).cast("int")))
    given = F.when(F.col("s_nationkey") > 0, code)
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", rp.currency_symbol(given).alias("shown")
    )


_POPULAR_SQL = "[" + ", ".join(f"'{t}'" for t in POPULAR_TICKERS) + "]"


@query(
    "i12_watchlist",
    f"""WITH firsts AS (SELECT user_id, upper(event_type) AS t, min(event_id) AS e FROM events
      GROUP BY ALL),
    own AS (SELECT user_id, list(t ORDER BY e) || ['TSLA'] AS mine FROM firsts GROUP BY user_id)
    SELECT user_id, array_to_string(mine || list_filter({_POPULAR_SQL},
      lambda p: NOT list_contains(mine, p)), ',') AS watchlist FROM own""",
)
def i12(spark, sf_dir):
    """Users' own lists (one entry per event type, so at most five, and one popular ticker)."""
    firsts = table(spark, sf_dir, "events").groupBy(
        "user_id", F.upper("event_type").alias("t")
    ).agg(F.min("event_id").alias("e"))
    own = firsts.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("e", "t"))).alias("mine")
    )
    mine = F.concat(F.transform("mine", lambda x: x["t"]), F.array(F.lit("TSLA")))
    return own.select("user_id", F.array_join(rp.watchlist(mine), ",").alias("watchlist"))
