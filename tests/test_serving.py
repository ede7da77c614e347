"""Prediction and search on own tables: stored bundles, the scaler at hand, placeholders."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from marketloom.operators import models as md
from marketloom.operators import serving as sv
from marketloom.operators.features import build_features, fit_scaler
from marketloom.operators.splits import sequences

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rows = []
    for name, days in (("A", 90), ("B", 90), ("SHORT", 5)):
        for k in range(days):
            close = 50 + 10 * math.sin(k / 5) + len(name)
            rows.append((name, DAY + dt.timedelta(days=k), close, close + 1, close - 1, close, 100.0 + k))
    return spark.createDataFrame(
        rows, "ticker string, date date, open double, high double, low double, close double, volume double"
    )


@pytest.fixture(scope="module")
def news(spark):
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    return spark.createDataFrame(
        [("A", "Profits surge to a record", at(3)), ("A", "profits SURGE to a record ", at(9)),
         ("A", "<b>A quiet day</b> of trading", None), ("B", "tiny", at(1)), ("B", None, at(1)),
         ("Z", "Nobody asked for this one", at(1))],
        "ticker string, headline string, date timestamp",
    )


@pytest.fixture(scope="module")
def bundle(spark, bars, news, tmp_path_factory):
    empty = spark.createDataFrame(
        [], "ticker string, date date, sentiment_positive double, sentiment_negative double, "
        "sentiment_neutral double, sentiment_score double",
    )
    features = build_features(bars, empty)
    plain = sv.Bundle(None, None).scaled(features)
    models = md.fit(md.samples(sequences(plain)), 0.01, iterations=3)
    path = str(tmp_path_factory.mktemp("bundle"))
    sv.Bundle(models).save(f"{path}/bare")
    sv.Bundle(models, fit_scaler(features)).save(f"{path}/full")
    return path


def test_cards_of_all_requested_tickers(spark, bars, news, bundle):
    asked = spark.createDataFrame([("A",), ("B",), ("SHORT",), ("NEW",), ("A",)], "ticker string")
    with pytest.warns(UserWarning, match="no scaler"):
        bare = sv.Bundle.load(spark, f"{bundle}/bare")
    rows = {r["ticker"]: r for r in bare.predict(asked, bars, news).collect()}
    assert sorted(rows) == ["A", "B", "NEW", "SHORT"]
    assert rows["A"]["news_count"] == 2 and rows["A"]["current_sentiment"] > 0
    assert rows["A"]["latest_headlines"] == ["Profits surge to a record", "A quiet day of trading"]
    assert rows["B"]["news_count"] == 0 and rows["B"]["current_sentiment"] == 0
    for name in ("SHORT", "NEW"):
        r = rows[name]
        assert (r["predicted_direction"], r["direction_label"], r["confidence"], r["predicted_return"]) == (0, "DOWN", 0.5, 0.0)
        assert r["news_count"] == 1 and r["latest_headlines"] == [sv.NO_NEWS]
    assert rows["A"]["confidence"] > 0.5


def test_scaler_at_hand_and_stored(spark, bars, bundle):
    rows = build_features(bars, spark.createDataFrame(
        [], "ticker string, date date, sentiment_positive double, sentiment_negative double, "
        "sentiment_neutral double, sentiment_score double"))
    full = sv.Bundle.load(spark, f"{bundle}/full")
    same = full.scaled(rows).agg(F.avg("rsi"), F.stddev_pop("rsi")).first()
    with pytest.warns(UserWarning):
        bare = sv.Bundle.load(spark, f"{bundle}/bare").scaled(rows).agg(F.avg("rsi"), F.stddev_pop("rsi")).first()
    assert same[0] == pytest.approx(0, abs=1e-9) and same[1] == pytest.approx(1)
    assert tuple(bare) == pytest.approx(tuple(same), abs=1e-9)
    # Half of the rows meet the stored scaler of all of them, not one of their own.
    half = full.scaled(rows.filter("ticker = 'A' AND date < '2024-02-20'")).agg(F.avg("rsi")).first()[0]
    assert abs(half) > 1e-3


def test_stored_text_index(spark, tmp_path):
    texts = spark.createDataFrame(
        [(1, "oil prices rise", "x"), (2, "rain in spring", "y"), (3, "oil exports fall", "z"), (4, None, "n")],
        "doc_id int, text string, kind string",
    )
    sv.TextIndex.store(texts, str(tmp_path / "index"))
    index = sv.TextIndex.load(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(7, "Oil prices rise "), (8, None)], "query_id int, text string")
    hits = {(r["query_id"], r["rank"]): r for r in index.search(asked, 2).collect()}
    assert hits[7, 1]["vec_id"] == 1 and hits[7, 1]["similarity_score"] == pytest.approx(1)
    assert hits[7, 1]["kind"] == "x" and hits[7, 2]["vec_id"] == 3
    assert hits[8, 1]["similarity_score"] == 0
    news = spark.createDataFrame(
        [(10, "T", "rain in spring", 5), (11, "T", "oil exports fall", 9), (12, "T", "oil", 1)],
        "doc_id int, ticker string, headline string, at int",
    )
    near = index.similar_to_latest(news, [F.col("at").desc(), F.col("doc_id")], latest=2, k=1).collect()
    assert sorted((r["position"], r["query_id"], r["vec_id"]) for r in near) == [(1, 11, 3), (2, 10, 2)]
