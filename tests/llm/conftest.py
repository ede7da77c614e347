import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    """A seeded generator of invented sentences with accents and capitals."""
    letters = "abcdefghijklmnopqrstuvwxyzéüñ"

    def make(seed, count):
        rng = random.Random(seed)
        pool = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(300)]
        return " ".join(rng.choice(pool) for _ in range(count))

    return make


@pytest.fixture(scope="session")
def odd_docs(words):
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies."""
    base = words(1, 120)
    long_ = words(2, 30_000)
    rows = [
        (1, base, "aa", "s", 1), (2, base, "aa", None, None), (3, base + " and one more end", "aa", "s", 2),
        (4, "", "aa", "s", 0), (5, None, "bb", "s", None), (6, "  \n\t ", None, "s", 3),
        (7, words(3, 60), "bb", "s", 4), (7, words(3, 60), "bb", "s", 4), (None, base, "aa", "s", 1),
        (8, long_, "aa", "s", 5), (9, long_[:5000] + words(4, 50), "aa", "s", 6), (10, "x" * 700, None, None, None),
        (11, words(5, 40) + base[100:330] + words(6, 40), "bb", "s", 7), (12, "one two", "aa", "s", 8),
        (13, "ONE  two\n", "aa", "s", 9), (14, "12 34 !!", "aa", "s", 9),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_frame(spark, odd_docs):
    """The odd rows with extra columns whose names clash with internal and result columns."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_docs, DOCS).select(
        "*", *[F.lit(0).alias(n) for n in ("_row", "node", "score", "doc", "mark", "hits", "piece", "row",
                                             "_ranges", "_doc", "_mark", "_spans", "_changed")]
    )


@pytest.fixture(scope="session")
def empty_frame(spark):
    return spark.createDataFrame([], DOCS)
