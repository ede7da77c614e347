import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import language


@pytest.fixture(scope="module")
def corpus():
    """Two invented languages with their own letters, and the rows to learn from."""
    rng = random.Random(1)
    syllables = {"xa": ["ka", "to", "mi", "re", "sul", "pen"], "yb": ["schu", "ver", "ung", "eit", "mi", "pf"]}

    def text(lang, count):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(count))

    return [(i, text(lang, rng.randint(3, 80)), lang) for i in range(400) for lang in [rng.choice(["xa", "yb"])]]


@pytest.fixture(scope="module")
def models(spark, corpus):
    return language.fit(spark.createDataFrame(corpus, "doc_id long, text string, lang string"))


def plain_probability(text_rows, gram):
    """Interpolated Kneser-Ney by its definition, on dictionaries."""
    counts = {}
    for text in text_rows:
        padded = "   " + language.cleaned(text)
        for at in range(len(padded) - 3):
            counts[padded[at:at + 4]] = counts.get(padded[at:at + 4], 0) + 1
    levels = [counts]
    for _ in range(3):
        lower = {}
        for g in levels[-1]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        levels.append(lower)

    def p(g, level):
        if not g:
            return 1 / (len(levels[3]) + 1)
        table = levels[level]
        once = sum(c == 1 for c in table.values())
        twice = sum(c == 2 for c in table.values())
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        after = [c for h, c in table.items() if h[:-1] == g[:-1]]
        if not after:
            return p(g[1:], level + 1)
        return max(table.get(g, 0) - d, 0) / sum(after) + d * len(after) / sum(after) * p(g[1:], level + 1)

    return p(gram, 0)


def test_models_are_kneser_ney(corpus):
    texts = [t for _, t, lang in corpus if lang == "xa"][:30]
    grams = np.concatenate([language.packed(language.codes("   " + language.cleaned(t)), 4) for t in texts])
    keys, counts = np.unique(grams, return_counts=True)
    models = language._assembled(["xa"], [language._Estimate(keys, counts)])
    for gram in ("kato", "tomi", " mi ", "zzzz", "kazz", "zzka", "   k", "kat~"):
        got = models.log_probabilities(language.codes(gram))[0, 0]
        assert got == pytest.approx(np.log(plain_probability(texts, gram)), abs=1e-5), gram


def test_probabilities_sum_to_one(models):
    letters = sorted(set("katomiresulpenschuvergtpf d") - {"d"})
    total = np.exp(models.log_probabilities(language.codes("".join("kat" + c for c in letters)))[::4]).sum(0)
    assert (total <= 1.05).all() and total[models.languages.index("xa")] > 0.9


def test_hash_array_finds_exactly_its_keys():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 60, 5000, dtype=np.uint64))
    table = language.HashArray(keys, keys.astype(np.float64)[:, None])
    found = table.find(np.concatenate([keys, keys + np.uint64(1)]))
    assert (table.rows[found[: len(keys)], 0] == keys.astype(np.float32)).all()
    there = np.isin(keys + np.uint64(1), keys)
    assert ((found[len(keys):] >= 0) == there).all()


def test_held_out_accuracy_and_rejection(spark, corpus):
    docs = spark.createDataFrame(
        [*corpus, (900, "qxz jjw vvkx zzqp wwxj qqzv kjx", "xa"), (901, "KATO!! remi 12 sul&&&pento", None)],
        "doc_id long, text string, lang string",
    )
    rows = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    right = [rows[i].lang_pred == lang for i, _, lang in corpus if rows[i].held_out]
    assert len(right) > 50 and all(right)
    assert not any(rows[i].rejected for i, *_ in corpus)
    assert rows[900].rejected and not rows[901].rejected and rows[901].lang_pred == "xa"
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_labels_of_held_out_rows_are_not_used(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    held = language.held_out(F.col("doc_id"))
    twisted = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    pick = ["doc_id", "lang_pred", "score"]
    assert sorted(language.identify(docs).select(pick).collect()) == sorted(language.identify(twisted).select(pick).collect())


def test_odd_rows(odd_docs, odd_frame, empty_frame, spark):
    rows = language.identify(odd_frame)
    assert rows.count() == len(odd_docs)
    found = [(r.text, r.lang_pred, r.score) for r in rows.collect()]
    assert all(p == "und" and s == 0 for t, p, s in found if not t or not any(c.isalpha() for c in t))
    assert all(p in ("aa", "bb") for t, p, s in found if t and any(c.isalpha() for c in t))
    assert language.identify(empty_frame).collect() == []
    blank = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score, r.rejected) for r in language.identify(blank).collect()] == [("und", 0.0, True)]


def test_mislabelled_texts_do_not_open_the_gate(spark):
    """A related language (half its syllables shared) is rejected, also with texts of it under the wrong label."""
    rng = random.Random(8)
    own, other = ["ka", "to", "mi", "re", "sul", "pen"], ["ka", "to", "mi", "zo", "wug", "fla"]

    def text(syllables):
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(80))

    rows = [(i, text(own), "xa") for i in range(600)]
    marks = spark.range(600, 3000).select(
        "id", (F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(language.CALIBRATION_SHARE)) == 0).alias("c")
    ).filter("c").limit(2).collect()
    rows += [(r.id, "qxz jjw vvkx zzqp wwxj " * 20, "xa") for r in marks]
    models = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    _, _, rejected = models.predict([text(other) for _ in range(100)])
    assert rejected.mean() > 0.95
    _, _, rejected = models.predict([text(own) for _ in range(400)])
    assert rejected.mean() <= 0.01
