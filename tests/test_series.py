"""Series scans against plain Python: smoothing, chunks, running values, numbering, medians."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from marketloom.operators import indicators as ind
from marketloom.operators import ordering as od
from marketloom.operators import series as sr


def ewm(values, alpha):
    out = []
    for x in values:
        out.append(x if not out else alpha * x + (1 - alpha) * out[-1])
    return out


@pytest.fixture(scope="module")
def ticks(spark):
    """One key holds most rows; rows arrive unsorted."""
    rng = random.Random(5)
    rows = [
        (("hot" if k % 10 else "cold"), k, rng.uniform(1, 100)) for k in range(3000)
    ]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, "key string, at bigint, value double")


def by_key(rows):
    out = {}
    for key, at, value in sorted(rows, key=lambda r: r[1]):
        out.setdefault(key, []).append((at, value))
    return out


@pytest.mark.parametrize("alpha", [1 / 200, 1 / 21, 1 / 14, 2 / 27, 0.2, 2 / 3, 0.99, 1.0])
def test_smoothing_equals_the_recursion(ticks, alpha):
    rows, df = ticks
    got = sr.smooth(
        sr.with_blocks(df, ["key"], "at"), {"y": ("value", alpha, 0)}, ["key"], "at"
    ).collect()
    got = {(r["key"], r["at"]): r["y"] for r in got}
    for key, series in by_key(rows).items():
        for (at, _), want in zip(series, ewm([v for _, v in series], alpha)):
            assert got[key, at] == pytest.approx(want, rel=1e-12)


def test_smoothing_rejects_what_is_no_alpha(ticks):
    for alpha in (0, -0.1, 1.1):
        with pytest.raises(ValueError):
            sr.smooth(ticks[1], {"y": ("value", alpha, 0)}, ["key"], "at")


def test_blocks_of_every_alpha_decay_and_stay_finite():
    for alpha in (1e-4, 1 / 50, 1 / 14, 0.5, 0.51, 0.9, 0.9999):
        rows = sr.block_rows(alpha)
        assert (1 - alpha) ** rows < 1e-27 and (1 - alpha) ** -float(rows - 1) < 1e300


def test_chunked_series_equal_whole_series(ticks):
    rows, df = ticks

    def build(part, keys):
        blocks = sr.with_blocks(part, keys, "_position")
        return sr.smooth(blocks, {"y": ("value", 0.2, 0)}, keys, "_position").drop("_row", "_block")

    got = sr.in_chunks(df, ["key"], ["at"], build, chunk_rows=300, back=290).collect()
    assert len(got) == len(rows)
    got = {(r["key"], r["at"]): r["y"] for r in got}
    for key, series in by_key(rows).items():
        for (at, _), want in zip(series, ewm([v for _, v in series], 0.2)):
            assert got[key, at] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("fan_in", [3])
@pytest.mark.parametrize("kind", ["sum", "product", "max", "last"])
def test_running_values(spark, kind, fan_in):
    rng = random.Random(9)
    rows = [("a" if k % 5 else None, k, rng.choice([None, rng.uniform(0.9, 1.1)])) for k in range(400)]
    df = spark.createDataFrame(rows, "key string, at bigint, value double").repartition(4)
    got = sr.running(df, ["key"], ["at"], F.col("value"), "y", kind, 16, fan_in).collect()
    got = {(r["key"], r["at"]): r["y"] for r in got}
    for key, series in by_key(rows).items():
        y = None
        for at, v in series:
            if v is not None:
                if y is None or kind == "last":
                    y = v
                else:
                    y = {"sum": y + v, "product": y * v, "max": max(y, v)}[kind]
            assert got[key, at] == (pytest.approx(y) if y is not None else None)


def test_a_key_of_many_chunks_meets_in_bounded_groups(spark):
    """100,000 chunks of one key: no level puts more than the fan-in into one window."""
    totals = spark.range(100_000).select(
        F.lit("hot").alias("key"), F.col("id").alias("_place"), F.col("id").alias("_total")
    )
    levels = sr.carry_levels(totals, ["key"], 99_999, "sum", fan_in=32)
    sizes = [
        level.groupBy("key", "_group").count().agg(F.max("count"), F.sum("count"), F.count("*")).first()
        for level in levels
    ]
    assert [tuple(s) for s in sizes] == [(32, 100_000, 3125), (32, 3125, 98), (32, 98, 4), (4, 4, 1)]
    carry = sr.carried(levels, ["key"], "sum")
    place = F.col("_place")
    wrong = carry.filter(~F.col("_carry").eqNullSafe(F.when(place > 0, (place * (place - 1) / 2).cast("bigint"))))
    assert carry.count() == 100_000 and wrong.count() == 0


def test_running_over_an_empty_table(spark):
    empty = spark.createDataFrame([], "key string, at bigint, value double")
    assert sr.running(empty, ["key"], ["at"], F.col("value"), "y").collect() == []


def test_numbering_positions_and_medians(ticks):
    rows, df = ticks
    numbers = {r["at"]: r["idx"] for r in od.numbered(df, ["at"]).collect()}
    assert numbers == {k: k for k in range(3000)}
    got = {(r["key"], r["at"]): r["position"] for r in od.position_in_key(df, ["key"], ["at"]).collect()}
    medians = {r["key"]: r["value"] for r in od.exact_median(df, ["key"], ["value"]).collect()}
    for key, series in by_key(rows).items():
        assert [got[key, at] for at, _ in series] == list(range(len(series)))
        assert medians[key] == pytest.approx(statistics.median(v for _, v in series))


def test_top_and_first_per_key(ticks):
    rows, df = ticks
    top = od.top_per_key(df, ["key"], [F.col("value").desc(), F.col("at")], 7).collect()
    first = od.keep_first(df, ["key"], [F.col("at")]).collect()
    for key, series in by_key(rows).items():
        want = sorted(series, key=lambda s: (-s[1], s[0]))[:7]
        mine = sorted((r["rank"], r["at"]) for r in top if r["key"] == key)
        assert [at for _, at in mine] == [at for at, _ in want]
        assert [r["at"] for r in first if r["key"] == key] == [series[0][0]]


def bars_of(spark, closes, ticker="A"):
    rows = [(ticker, k, c, c + 1, c - 1, 10.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(
        rows, "ticker string, date int, close double, high double, low double, volume double"
    )


def test_indicators_of_a_constant_price(spark):
    rows = ind.add_indicators(bars_of(spark, [5.0] * 60)).orderBy("date").collect()
    assert rows[12]["rsi"] is None and rows[13]["rsi"] == 100.0
    assert rows[24]["macd"] is None and rows[25]["macd"] == pytest.approx(0)
    assert rows[32]["macd_signal_line"] is None and rows[33]["macd_signal_line"] == pytest.approx(0)
    assert rows[18]["bb_upper"] is None and rows[19]["bb_pct"] is None
    assert rows[59]["obv"] == 600.0 and rows[13]["atr"] == pytest.approx(2.0)
    assert rows[19]["volatility_20d"] is None and rows[20]["volatility_20d"] == 0
    assert rows[59]["target_direction"] == 0 and rows[59]["target_return"] is None


def test_short_series_have_no_indicators_and_one_ticker_equals_many(spark):
    rng = random.Random(1)
    closes = [rng.uniform(10, 20) for _ in range(50)]
    both = bars_of(spark, closes).unionByName(bars_of(spark, [7.0], "B")).repartition(3)
    many = ind.add_indicators(both)
    assert many.filter("ticker = 'B'").first()["rsi"] is None
    alone = ind.add_indicators(bars_of(spark, closes)).orderBy("date").collect()
    assert many.filter("ticker = 'A'").orderBy("date").collect() == alone
