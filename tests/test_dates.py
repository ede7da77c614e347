"""Date texts of feeds and files, and character references."""

import html

import pytest
from pyspark.sql import functions as F

from marketloom.functions.dates import instant
from marketloom.functions.text import unescape
from marketloom.operators import ordering, similarity

DATES = {
    "Tue, 05 Mar 2024 09:00:00 -0500": "2024-03-05 14:00:00", "Tue, 05 Mar 2024 09:00:00 EST": "2024-03-05 14:00:00",
    "Tue, 5 Mar 2024 09:00:00 GMT": "2024-03-05 09:00:00", "2024-03-05T09:00:00Z": "2024-03-05 09:00:00",
    "06/05/2020": "2020-06-05 00:00:00", "June 5, 2020": "2020-06-05 00:00:00",
    "Fri, 05 Jun 2020 10:00:00 GMT": "2020-06-05 10:00:00", "20200605": "2020-06-05 00:00:00",
    "2020-06-05 10:30:54-04:00": "2020-06-05 14:30:54", "13/05/2020": "2020-05-13 00:00:00",
    "Jun. 5th, 2020 12:30 am": "2020-06-05 00:30:00", "2024-03-05 09:00:00 +0000 UTC": "2024-03-05 09:00:00",
    "2020-06-05T10:30:54.123456+05:30": "2020-06-05 05:00:54.123456", "yesterday": None, "2020-02-30": None, "": None,
    # parts alone
    "2024-03": "2024-03-01 00:00:00", "03/2024": "2024-03-01 00:00:00", "Mar 2024": "2024-03-01 00:00:00",
    "2024": "2024-01-01 00:00:00", "2024 March": "2024-03-01 00:00:00", "September 2024": "2024-09-01 00:00:00",
    # clocks
    "2024-03-05 9am": "2024-03-05 09:00:00", "5 March 2024 at 10:30 p.m. EST": "2024-03-06 03:30:00",
    "2024-03-05T09": "2024-03-05 09:00:00", "2024-03-05T0915": "2024-03-05 09:15:00",
    "20240305T090000Z": "2024-03-05 09:00:00", "20240305090000": "2024-03-05 09:00:00", "202403050915": "2024-03-05 09:15:00",
    "20240305T09": "2024-03-05 09:00:00", "2024-03-05 12 PM": "2024-03-05 12:00:00", "2024-03-05 09:00:00,5": "2024-03-05 09:00:00.500000",
    "20240305T090000+0530": "2024-03-05 03:30:00", "Mar 5 2024 9:05PM": "2024-03-05 21:05:00",
    # orders and glue
    "Mar-05-2024": "2024-03-05 00:00:00", "05Mar2024": "2024-03-05 00:00:00", "2024-Mar-05": "2024-03-05 00:00:00",
    "05-Mar-24": "2024-03-05 00:00:00", "5. March 2024": "2024-03-05 00:00:00", "the 5th of March, 2024": "2024-03-05 00:00:00",
    "Tue Mar  5 09:00:00 2024": "2024-03-05 09:00:00", "Tue Mar 05 09:00:00 EST 2024": "2024-03-05 14:00:00",
    "Sept 5, 2024": "2024-09-05 00:00:00", "5.3.2024": "2024-05-03 00:00:00", "25.3.2024": "2024-03-25 00:00:00",
    "03/05/99": "1999-03-05 00:00:00",
    # zones
    "Tue, 05 Mar 2024 09:00:00 GMT+0530": "2024-03-05 03:30:00", "2024-03-05 09:00 GMT-5": "2024-03-05 14:00:00",
    "Tue Mar 05 2024 09:00:00 GMT+0530 (India Standard Time)": "2024-03-05 03:30:00",
    "05 Mar 2024 09:00:00 CET": "2024-03-05 08:00:00", "05 Mar 2024 09:00:00 IST": "2024-03-05 03:30:00",
    "05 Mar 2024 09:00 BST": "2024-03-05 08:00:00", "05 Mar 2024 09:00:00 -0500 (EST)": "2024-03-05 14:00:00",
    "05 Mar 2024 09:00:00 (PST)": "2024-03-05 17:00:00", "2024-03-05+01:00": "2024-03-04 23:00:00",
    "05 Mar 2024 09:00:00 QQT": None, "05 Mar 2024 09:00:00 Europe/Berlin": None,
    # no dates
    "12:30": None, "Mar 5": None, "5": None, "2024-13": None, "2024-03-05 25:00": None, "2024-03-05 10:61": None,
    "2024-03-05 13pm": None, "2024-03-05 09:00:60": None, "1, 2, 3, 4": None, "9:00 2024-03-05 10:00": None,
    "Mar Apr 2024": None, "about 2024-03-05": None, "2024-03-05 #1": None, "0001-01-01": None, "9999-12-31": None, "March": None,
    "2024-03-05 09:00:00+99:00": None, "123456789": None, "５ März 2024": None,
}


def test_dates(spark):
    rows = spark.createDataFrame([(d,) for d in [*DATES, None]], "d string").select("d", instant(F.col("d")).alias("t"))
    got = {r.d: None if r.t is None else str(r.t) for r in rows.collect()}
    assert got == {**DATES, None: None}


def test_references_equal_the_standard_library(spark):
    texts = ["&#8217;x&eacute;&rsquo;&#x27;", "a &amp;lt; b &amp &ampx; &notit; &copy2 &bogus; & &# &#0; &#128;",
             "&#x110000;&#xD800;&#1;", "&nbsp;", "none", "&#x26;amp; &sum;&NotEqualTilde;&am", "&#99999999999999999999999;"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", unescape(F.col("t")).alias("u"))
    assert {r.t: r.u for r in rows.collect()} == {**{t: html.unescape(t) for t in texts}, None: None}


def test_ties_do_not_fill_one_partition(spark):
    """Nine in ten values are equal; counted, they are one row of the numbering."""
    rows = spark.range(40_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 20 < 18, 0.0).otherwise(F.col("id") / 1.0).alias("v"))
    got = {r.k: r.v for r in ordering.exact_median(rows, ["k"], ["v"]).collect()}
    assert got == {0: 0.0, 1: 0.0}
    few = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 4.0), ("a", 6.0), ("b", 3.0), (None, 2.0), (None, 5.0)], "k string, v double")
    assert {r.k: r.v for r in ordering.exact_median(few, ["k"], ["v"]).collect()} == {"a": 2.5, "b": 3.0, None: 3.5}


def test_top_per_key_over_many_partitions(spark):
    rows = spark.range(0, 5000, 1, 300).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    got = [r.v for r in ordering.top_per_key(rows, ["k"], [F.col("v").desc()], 7).orderBy("rank").collect()]
    assert got == list(range(4999, 4992, -1))


@pytest.mark.parametrize("count", [3, 20_000])
def test_score_blocks_stay_small(count):
    """However many queries, a block of scores has at most ``SLICE_QUERIES`` rows."""
    import numpy as np

    rng = np.random.default_rng(1)
    vectors, queries = rng.normal(size=(50, 4)), rng.normal(size=(count, 4))
    seen, plain = [], similarity._best_of_slice

    def spy(ids, matrix, query_ids, part, k):
        seen.append(len(part))
        return plain(ids, matrix, query_ids, part, k)

    similarity._best_of_slice = spy
    try:
        best = similarity._best(np.arange(50), vectors, np.arange(count), queries, 5)
    finally:
        similarity._best_of_slice = plain
    assert max(seen) <= similarity.SLICE_QUERIES and len(best) == 5 * count
    assert (best["vec_id"].to_numpy()[::5] == np.argmax(np.round(queries @ vectors.T, 9), axis=1)).all()


def test_a_runs_tables_can_be_cleared(spark):
    import os

    from marketloom.workspace import clear, run_folder, written

    assert written(spark.range(5), "five").count() == 5
    folder = run_folder(spark).removeprefix("file:")
    assert os.path.isdir(folder)
    clear(spark)
    assert not os.path.exists(folder)
