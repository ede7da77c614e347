"""Packed orders, late first rows, and rows in the order of their files."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators.ordering import exact_median, keep_first, packed
from marketloom.sources import headlines as hl
from marketloom.sources.bars import daily_bars


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_numbers_sort_as_their_columns(spark):
    days = [None, datetime.date(1901, 2, 3), datetime.date(2024, 2, 29)]
    rows = list(itertools.product([None, False, True], [None, -5, 0, 2**31 - 1], [-(2**31), 7], days))
    df = spark.createDataFrame(rows, "a boolean, b int, c int, d date")
    whole = packed(df, ["a", "b", "c", "d"])
    by_number = [tuple(r)[:4] for r in df.withColumn("n", whole).orderBy("n").collect()]
    assert by_number == [tuple(r) for r in df.orderBy("a", "b", "c", "d").collect()]
    long_ = spark.createDataFrame([(x, y) for x in (None, -(2**63), -1, 2**63 - 1) for y in (None, False, True)], "a long, b boolean")
    ranked = [tuple(r)[:2] for r in long_.withColumn("n", packed(long_, ["a", "b"])).orderBy("n").collect()]
    assert ranked == [tuple(r) for r in long_.orderBy("a", "b").collect()]


def test_what_cannot_be_packed(spark):
    df = spark.createDataFrame([("x", 1, 2)], "s string, a long, b long")
    assert packed(df, ["s"]) is None and packed(df, ["a", "b"]) is None
    assert packed(df, ["a", "b"], [40, 40]) is not None
    with pytest.raises(Exception, match="beyond 3 bits"):
        spark.createDataFrame([(8, 1)], "a long, b long").select(packed(df, ["a", "b"], [3, 3])).collect()


def test_first_rows_are_fetched_late(spark):
    texts = ["same text"] * 300 + [None] * 5 + [f"text {i}" for i in range(20)]
    rows = [(i * 7 % 325, t, f"payload {i * 7 % 325}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "n long, text string, more string").repartition(5)
    first = keep_first(df, ["text"], [F.col("n")])
    want = {}
    for n, text, more in rows:
        want[text] = min(want.get(text, (n, more)), (n, more))
    assert {r.text: (r.n, r.more) for r in first.collect()} == want
    assert "SortAggregate" not in plan(first)
    sorted_ = keep_first(df, ["text"], [F.col("more")])  # strings are not packed: same rule by comparison
    assert {r.text: r.more for r in sorted_.collect()} == {
        t: min(m for _, x, m in rows if x == t) for t in set(texts)
    }


def test_computed_keys_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "A", 0), (2, "a", 1), (3, "b", 2)], "n int, text string, `_none` int")
    got = keep_first(df, [F.lower("text")], [F.col("n")], ["low"])
    assert got.columns == ["n", "text", "_none", "low"]
    assert sorted(map(tuple, got.collect())) == [(1, "A", 0, "a"), (3, "b", 2, "b")]
    assert keep_first(df.limit(0), ["text"], [F.col("n")]).count() == 0


def test_bars_are_hashed(spark):
    day = datetime.date(2024, 1, 2)
    trades = spark.createDataFrame(
        [("t", day, float(p), 1.0, s, l) for p, s, l in [(5, 3, 1), (7, 1, 2), (6, 1, 1), (2, 2, 9), (8, 3, 0)]],
        "ticker string, date date, price double, volume double, s long, l int",
    )
    for sequence in ({"s": 40, "l": 8}, ["s", "l"]):
        bars = daily_bars(trades, sequence)
        assert tuple(bars.first()) == ("t", day, 6.0, 8.0, 2.0, 5.0, 5.0)
        assert "SortAggregate" not in plan(bars)


def test_first_in_the_file_stays(spark, tmp_path):
    folder = tmp_path / "two files"
    folder.mkdir()
    (folder / "b.csv").write_text("title,date\nsecond headline,2020-01-01\na third headline,2020-01-01\n")
    (folder / "a.csv").write_text(
        "title,date\n" + "".join(f"a long enough headline {i % 50},2024-01-{i // 50 + 1:02d}\n" for i in range(99, -1, -1))
        + "second headline,2024-05-05\n"
    )
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = {r.headline: str(r.date)[:10] for r in hl.load(spark, str(folder)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 52 and rows["second headline"] == "2024-05-05"
    assert {v for k, v in rows.items() if k.startswith("a long")} == {"2024-01-02"}


def middle(values):
    ordered = sorted(values)
    return ordered[(len(ordered) - 1) // 2] / 2 + ordered[len(ordered) // 2] / 2


@pytest.mark.parametrize("most_rows", [0, 40, 10**6])
def test_medians_by_selection(spark, most_rows):
    rng = random.Random(4)
    kinds = {
        "even": lambda: rng.random(), "ties": lambda: float(rng.choice([0, 0, 0, 1, 2])), "one": lambda: 7.0,
        "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300), "huge": lambda: rng.choice([-1.7e308, 1.7e308, 0.5, -3.0]),
        None: lambda: rng.gauss(0, 1e-9) + 1, "ends": lambda: rng.choice([float("-inf"), 1.0, 2.0, 3.0, float("inf")]),
    }
    rows = [(k, make(), rng.random()) for k, make in kinds.items() for _ in range(rng.choice([30, 51, 100]))]
    rows += [("few", 1.0, None), ("few", None, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(4)
    got = {r.k: (r.a, r.b) for r in exact_median(df, ["k"], ["a", "b"], most_rows).collect()}
    want = {}
    for k in {r[0] for r in rows} - {"none"}:
        columns = [[r[i] for r in rows if r[0] == k and r[i] is not None] for i in (1, 2)]
        want[k] = tuple(middle(c) if c else None for c in columns)
    assert got.keys() == want.keys()
    for k in want:
        for mine, its in zip(got[k], want[k]):
            assert mine == (its if its is None else pytest.approx(its, rel=1e-12)), k
