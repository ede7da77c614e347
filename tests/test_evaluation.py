"""Evaluation, features, splits, vectors and reports on hand-made cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import evaluation as ev
from marketloom.operators import features as ft
from marketloom.operators import models as md
from marketloom.operators import reporting as rp
from marketloom.operators import similarity as sm
from marketloom.operators import splits as sp

TYPES = "ticker string, date int, actual int, predicted int, actual_return double"


def days(spark, returns, predicted, ticker="A"):
    rows = [(ticker, k, int(r > 0), p, float(r)) for k, (r, p) in enumerate(zip(returns, predicted))]
    return spark.createDataFrame(rows, TYPES)


def test_always_long_equals_buy_and_hold(spark):
    row = ev.evaluate(days(spark, [0.1, -0.2, 0.05], [1, 1, 1])).first()
    assert row["excess_return"] == 0 and row["n_trades"] == 0 and row["total_costs"] == 0
    assert row["recall"] == 1.0 and row["precision"] == pytest.approx(2 / 3)


def test_one_flip_costs_twice_the_rate_and_the_first_position_is_free(spark):
    ledger = ev.ledger(days(spark, [0.1, -0.2], [1, 0])).orderBy("date").collect()
    assert [r["cost"] for r in ledger] == [0.0, pytest.approx(0.002)]
    assert ledger[1]["strategy_return"] == pytest.approx(0.2 - 0.002)


def test_no_variation_and_losses_beyond_everything(spark):
    flat = ev.evaluate(days(spark, [0.0] * 4, [1, 1, 1, 1])).first()
    assert flat["strategy_sharpe"] == 0 and flat["improvement_pct"] == 0
    ruin = ev.evaluate(days(spark, [0.5, -1.5, 0.5], [1, 1, 1])).first()
    assert ruin["buyhold_return"] == pytest.approx(1.5 * -0.5 * 1.5 - 1)
    assert ruin["buyhold_max_drawdown"] == pytest.approx((-1.125 - 1.5) / 1.5)


def test_drawdown_peak_starts_at_the_first_day(spark):
    row = ev.evaluate(days(spark, [-0.5, 0.1], [1, 1])).first()
    assert row["buyhold_max_drawdown"] == 0


def test_empty_input(spark):
    empty = days(spark, [], [])
    assert ev.evaluate(empty).count() == 0
    row = ev.precision_recall(empty).first()
    assert (row["precision"], row["recall"], row["f1_score"]) == (0, 0, 0)


def test_universal_row_pools_tickers(spark):
    both = days(spark, [0.1, 0.2], [1, 1]).unionByName(days(spark, [-0.1, 0.0], [1, 0], "B"))
    row = ev.evaluate_universal(both).first()
    assert row["directional_accuracy"] == pytest.approx(3 / 4)
    assert row["buyhold_return"] == pytest.approx(1.0 * 1.1 - 1)
    assert row["chained_buyhold_return"] == pytest.approx(1.1 * 1.2 * 0.9 * 1.0 - 1)
    table = {r["ticker"] for r in ev.summary_table(both).collect()}
    assert table == {"A", "B", "_UNIVERSAL"}


def test_scaler(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "rsi double, macd double")
    scaler = ft.fit_scaler(rows)
    got = {r["feature"]: (r["mean"], r["scale"]) for r in scaler.collect()}
    assert got["macd"] == (5.0, 1.0)
    assert got["rsi"] == (pytest.approx(4 / 3), pytest.approx(np.std([1, 3, 0])))
    scaled = ft.apply_scaler(rows, scaler).collect()
    assert sum(r["rsi"] for r in scaled) == pytest.approx(0) and scaled[0]["macd"] == 0
    with pytest.raises(RuntimeError):
        ft.apply_scaler(rows, None)
    with pytest.raises(ValueError):
        ft.feature_columns(spark.range(1))


@pytest.mark.parametrize("n", [0, 1, 31, 100])
def test_splits_and_windows(spark, n):
    rows = spark.createDataFrame(
        [("A", k, float(k), 1, 0.5) for k in range(n)],
        "ticker string, date int, rsi double, target_direction int, target_return double",
    )
    for labelled in (sp.split_per_ticker(rows), sp.split_all(rows, ["date"])):
        got = [r["split"] for r in labelled.orderBy("date").collect()]
        a, b = int(n * 0.70), int(n * 0.85)
        assert got == ["train"] * a + ["val"] * (b - a) + ["test"] * (n - b)
    windows = sp.sequences(rows).orderBy("date").collect()
    assert len(windows) == max(0, n - 30)
    for w in windows:
        assert [s[0] for s in w["sequence"]] == [float(k) for k in range(w["date"] - 30, w["date"])]


def test_search_ways_agree_with_numpy(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(200, 8))
    vectors[50] = vectors[51] * 3  # a copy at another length ties
    vectors[60] = 0
    queries = np.vstack([rng.normal(size=(5, 8)), vectors[51]])
    table = sm.build(spark.createDataFrame(
        [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)],
        "vec_id bigint, embedding array<double>, label int"))
    asked = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(queries)],
        "query_id bigint, embedding array<double>")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    scores = np.round(queries / np.linalg.norm(queries, axis=1, keepdims=True) @ unit.T, 9)
    want = {(q, r + 1): v for q in range(6)
            for r, v in enumerate(sorted(range(200), key=lambda v: (-scores[q, v], v))[:4])}
    for limit in (sm.SHIPPED_BYTES, 0):
        hits = sm.search(table, asked, 4, shipped_bytes=limit).collect()
        assert {(h["query_id"], h["rank"]): h["vec_id"] for h in hits} == want
    assert want[5, 1] == 50 and want[5, 2] == 51


def test_search_edges(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<double>")
    empty = sm.search(sm.build(none), asked)
    assert empty.count() == 0
    assert sm.features(empty, asked).first()[1:] == (0.0, 0.0)
    two = sm.append(None, spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], none.schema))
    assert [h["rank"] for h in sm.search(two, asked, 9).orderBy("rank").collect()] == [1, 2]
    assert sm.size(sm.append(two, none)).first()["size"] == 2


def test_alerts_first_match_wins(spark):
    news = [("A", -0.9, "negative"), ("B", 0.9, "positive"), ("C", -0.1, "negative")]
    scored = spark.createDataFrame(news, "ticker string, sentiment_score double, label string")
    asked = spark.createDataFrame([(t,) for t in "ABCD"], "ticker string")
    got = {r["ticker"]: r["alert"] for r in rp.sentiment_alerts(asked, scored).collect()}
    assert got == {"A": "STRONG_NEG", "B": "STRONG_POS", "C": "MAJORITY_NEG", "D": "NO_NEWS"}


def test_small_report_expressions(spark):
    row = spark.range(1).select(
        rp.currency_symbol(F.lit("gbp")).alias("a"), rp.currency_symbol(F.lit("xyz")).alias("b"),
        rp.currency_symbol(F.lit(None).cast("string")).alias("c"),
        rp.display_name(F.lit("A"), F.lit("Alpha")).alias("d"),
        rp.display_name(F.lit("A"), F.lit("A")).alias("e"),
        rp.watchlist(F.array(F.lit("ZZ"), F.lit("V"))).alias("f"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]) == ("£", "xyz ", "$", "Alpha (A)", "A")
    assert row["f"][:3] == ["ZZ", "V", "AAPL"] and row["f"].count("V") == 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_symbol_lookup_takes_the_nearest(spark):
    names = spark.createDataFrame([("AAPL", "Apple"), ("GOOGL", "Google"), ("MSFT", "Microsoft")], "symbol string, name string")
    inputs = spark.createDataFrame([("aple",), ("Googgle",), ("aapl",), (" btc-usd",), ("Micrsft",), ("  ",), (None,)], "input string")
    got = {r["input"]: r["symbol"] for r in rp.resolve_symbols(inputs, names).collect()}
    assert got == {"aple": "AAPL", "Googgle": "GOOGL", "aapl": "AAPL", " btc-usd": "AAPL",
                   "Micrsft": "MSFT", "  ": "", None: None}
    near = {r["input"]: r["symbol"] for r in rp.resolve_symbols(inputs, names, max_distance=1).collect()}
    assert (near["Micrsft"], near["aple"], near[" btc-usd"]) == ("MICRSFT", "AAPL", "BTC-USD")
    none = {r["input"]: r["symbol"] for r in rp.resolve_symbols(inputs, names.limit(0)).collect()}
    assert none["aple"] == "APLE"


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyzé"])
def test_nearest_names_equal_comparing_all(spark, letters):
    rng = random.Random(len(letters))

    def text(most, of=letters):
        return "".join(rng.choice(of) for _ in range(rng.randint(1, most)))

    names = [(f"S{i:02d}", text(12)) for i in range(25)]
    asked = [text(16) for _ in range(30)] + [text(5, "0123") for _ in range(4)] + ["0" * 30, names[3][1], names[4][1] + "z"]
    rows = rp.nearest_names(
        spark.createDataFrame([(t,) for t in asked], "text string"),
        spark.createDataFrame(names, "symbol string, name string"),
    ).collect()
    want = {t: min((edits(t, n), s) for s, n in names) for t in asked}
    assert {r["text"]: (r["distance"], r["symbol"]) for r in rows} == want


def test_loss_floors_logs_and_cards_have_defaults(spark):
    rows = spark.createDataFrame(
        [("A", 1, 1.0, 0.0, 0, 0.0)],
        "ticker string, date int, probability double, predicted_return double, "
        "target_direction int, target_return double")
    assert md.combined_loss(rows).first()["direction_loss"] == 100.0
    asked = spark.createDataFrame([("A",), ("B",)], "ticker string")
    cards = {r["ticker"]: r for r in md.latest_card(asked, rows).collect()}
    assert cards["A"]["direction_label"] == "UP" and cards["A"]["confidence"] == 1.0
    assert (cards["B"]["predicted_direction"], cards["B"]["confidence"]) == (0, 0.5)


def test_models_fit_select_save_load(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for k in range(120):
        x = [[rng.uniform(-1, 1)] for _ in range(3)]
        rows.append(("A", k, x, int(x[2][0] > 0), x[2][0] * 0.1))
    data = md.samples(spark.createDataFrame(
        rows, "ticker string, date int, sequence array<array<double>>, target_direction int, "
        "target_return double"))
    models, losses = md.select(data, data, penalties=(0.001, 1.0))
    chosen = [r["penalty"] for r in losses.filter("chosen").collect()]
    assert chosen == [0.001]
    models.save(str(tmp_path / "m"))
    again = md.predict(md.Models.load(str(tmp_path / "m")), data)
    assert again.filter("predicted = target_direction").count() > 100


def test_ledger_of_two_tables_has_the_common_days(spark):
    actual = spark.createDataFrame(
        [("A", 1, 0.1), ("A", 2, -0.2), ("A", 3, 0.3)], "ticker string, date int, actual_return double"
    )
    predicted = spark.createDataFrame([("A", 2, 0), ("A", 3, 1), ("A", 4, 1)], "ticker string, date int, predicted int")
    rows = ev.ledger_of(actual, predicted).orderBy("date").collect()
    assert [r["date"] for r in rows] == [2, 3]
    assert [r["position"] for r in rows] == [-1.0, 1.0] and rows[1]["cost"] > 0
