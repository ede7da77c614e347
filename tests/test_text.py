"""Cleaning, sentiment and headline files on hand-made cases."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions import sentiment as sf
from marketloom.functions import text as tx
from marketloom.operators import sentiment as sn
from marketloom.sources import feeds, headlines

CASES = [
    (None, ""), ("   ", ""), ("  ", ""),
    ("<b>Big</b> gain", "Big gain"),
    ("See https://x.y/z?a=1 now", "See now"), ("go www.site.com ok", "go ok"),
    ("Breaking: Breaking: rates", "Breaking: rates"),
    ("BREAKING NEWS: up", "up"), ("update:x", "x"), (" Alert: x", "Alert: x"),
    ("Café €5 – naïve", "Café 5 naïve"), ("a@b#c", "a b c"), ("½ up", "½ up"),
    ("x" * 600, "x" * 512),
]


@pytest.mark.parametrize("raw,want", CASES)
def test_cleaning(spark, raw, want):
    row = spark.createDataFrame([(raw,)], "t string").select(tx.clean(F.col("t")).alias("t")).first()
    assert row["t"] == want


def test_jaccard_and_symbols(spark):
    row = spark.createDataFrame([("a b b", "B c", "")], "x string, y string, z string").select(
        tx.set_jaccard(tx.word_set(F.col("x")), tx.word_set(F.col("y"))).alias("xy"),
        tx.set_jaccard(tx.word_set(F.col("x")), tx.word_set(F.col("z"))).alias("xz"),
        tx.symbol(F.lit("brk-b.ns")).alias("s"),
        tx.html_to_text(F.lit("<i>R&amp;D</i> &lt;up&gt;")).alias("h"),
    ).first()
    assert row["xy"] == pytest.approx(1 / 3) and row["xz"] == 0
    assert row["s"] == "BRKB" and row["h"] == "R&D <up>"


def test_finance_words_decide_the_label(spark):
    rows = spark.createDataFrame(
        [("Profits surge to record",), ("Shares plunge on fraud",), ("Board meets",)],
        "headline string",
    )
    got = sf.with_sentiment(rows).collect()
    assert [r["label"] for r in got] == ["positive", "negative", "neutral"]
    for r in got:
        total = r["sentiment_positive"] + r["sentiment_negative"] + r["sentiment_neutral"]
        assert total == pytest.approx(1)
        assert r["sentiment_score"] == pytest.approx(
            r["sentiment_positive"] - r["sentiment_negative"]
        )


def test_daily_roll_up_drops_undated_rows(spark):
    rows = spark.createDataFrame(
        [("A", "2024-01-01 09:00:00", 1.0), ("A", "2024-01-01 17:00:00", 0.0), ("A", None, 9.0)],
        "ticker string, date string, sentiment_score double",
    ).withColumn("date", F.expr("cast(date as timestamp_ntz)"))
    for how in ("mean", "median", "unheard of"):
        row = sn.daily(rows, aggregation=how).first()
        assert row["sentiment_score"] == 0.5 and row["article_count"] == 2
    with pytest.raises(ValueError):
        sn.daily(rows.drop("sentiment_score"))


def test_headline_files(spark, tmp_path):
    (tmp_path / "named.csv").write_bytes(
        " Title ,Published,Stock\nCaf\xe9 chain profits rise,2024-03-01,AAA\n"
        "short,2024-03-01,AAA\nCaf\xe9 chain profits rise,2024-03-02,BBB\n"
        "Dates can be odd here,someday,CCC\n".encode("latin-1")
    )
    (tmp_path / "bare.csv").write_bytes(
        b"neutral,First headline without header\npositive,Second headline of the file\n"
    )
    (tmp_path / "wrong.csv").write_bytes(b"a,b\n1,2\n")
    rows = headlines.load(spark, str(tmp_path / "named.csv")).collect()
    assert [r["headline"] for r in rows] == ["Café chain profits rise", "Dates can be odd here"]
    assert rows[0]["ticker"] == "AAA" and rows[1]["date"] is None and rows[0]["source"] == "kaggle"
    bare = headlines.scan_csv(spark, str(tmp_path / "bare.csv"))
    assert bare.columns == ["sentiment", "headline"] and bare.count() == 2
    paths = [str(tmp_path / n) for n in ("named.csv", "missing.csv", "wrong.csv", "bare.csv")]
    assert headlines.load_many(spark, paths).count() == 4
    with pytest.raises(ValueError):
        headlines.load_many(spark, paths[1:3])
    with pytest.raises(Exception):
        headlines.load(spark, str(tmp_path / "missing.csv"))


def test_feeds(spark):
    items = spark.createDataFrame(
        [("<b>Up</b> &amp; away", "u", "Tue, 02 Jan 2024 10:00:00 GMT", "A"),
         ("  ", "u", None, "A"), ("Odd date", None, "soon", "A")],
        feeds.RSS_SCHEMA,
    )
    rows = feeds.rss_items(items, "google_news").orderBy("headline").collect()
    assert [r["headline"] for r in rows] == ["Odd date", "Up & away"]
    assert rows[0]["date"] is None and rows[0]["url"] == ""
    assert str(rows[1]["date"]) == "2024-01-02 10:00:00"
    entries = spark.createDataFrame([("A", 1, 1), ("A", 0, 2), ("B", 1, 3)],
                                    "ticker string, feed int, id int")
    assert {r["id"] for r in feeds.first_feed_with_rows(entries).collect()} == {2, 3}


def test_user_model_is_built_per_task_and_keeps_columns(spark):
    def make():
        def score(texts: pd.Series) -> pd.DataFrame:
            n = len(texts)
            return pd.DataFrame({"label": ["neutral"] * n, **{c: [0.5] * n for c in sf.SCORE_COLUMNS}})
        return score

    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, headline string")
    got = sn.score_with(rows, make).orderBy("id").collect()
    assert [(r["id"], r["headline"], r["label"]) for r in got] == [(1, "x", "neutral"), (2, "y", "neutral")]


def test_a_reference_is_read_once(spark):
    """Numbers, names and what is no reference; the number of a reference is written once in the expression."""
    import html

    texts = ["&#84;&#x54;&#XdF;&#126;&#127;&#32;&#31;&#9;&#128;&#0;&#1114112;&#xD800;", "&eacute;&ntilde&notit;&amp;amp;",
             "a & b &; &# &#x; &q; &e &T &zzz;", "&ampx&gt", "plain", "", "&#99999999999999999999999;&#xFFFFFFFFF;"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", tx.unescape(F.col("t")).alias("u"))
    assert {r.t: r.u for r in rows.collect()} == {t: html.unescape(t) for t in texts} | {None: None}
    assert str(tx.unescape(F.col("t"))).count("conv(") == 1


def test_plain_words_are_counted_as_by_patterns(spark):
    plain = sf.Lexicon(positive=("up", "x1"), negative=("down",), neutral=())
    texts = ["Up up, up-down UPSIDE x1", "down_ down’s é uṕ up", "‍up up x1 x1é", "", "  ", None, "DOWN\tup"]
    rows = spark.createDataFrame([(t,) for t in texts], "headline string")
    assert sf.plain(plain) and not sf.plain(sf.Lexicon(positive=("all-time",), negative=("beats?",)))
    patterned = sf.Lexicon(positive=("up", "x1"), negative=("(?:down)",), neutral=())
    found, want = (sf.with_sentiment(rows, lexicon=x).collect() for x in (plain, patterned))
    assert found == want


def test_a_cleaned_text_is_computed_once(spark):
    from marketloom.operators import dedupe

    rows = spark.createDataFrame([(1, "<b>long enough text</b>"), (2, "short"), (3, None)], "id int, headline string")
    kept = dedupe.long_enough(dedupe.clean_column(rows, "headline", keep_raw=False), "headline")
    assert kept.columns == ["id", "headline"] and [tuple(r) for r in kept.collect()] == [(1, "long enough text")]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("https?://") == 1
