import math
import re
from collections import Counter

import numpy as np
import pytest

from marketloom.llm import ranked
from marketloom.llm.ranked import build, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return [t.translate(UPPER) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, counts in held:
            m = 100 - 90 + (90 * sum(counts.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in set(terms(text)) if t in counts
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, unnamed, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item_id, rank, None if unnamed else doc_id, -score))
    return sorted(out, key=repr)


def got(spark, docs, items, k=10):
    documents = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    questions = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in search(build(documents), questions, k).collect()), key=repr)


@pytest.fixture
def small_slices(monkeypatch):
    """Slices, blocks and visits so small that every bound on them is passed."""
    monkeypatch.setattr(ranked, "SLICE_ROWS", 3)
    monkeypatch.setattr(ranked, "SLICE_WORDS", 60)
    monkeypatch.setattr(ranked, "BLOCK_CHARS", 60)
    monkeypatch.setattr(ranked, "HELD_POSTINGS", 50)


def corpus(odd_docs):
    rng = np.random.default_rng(5)
    pool = ["alpha", "Beta", "gämma", "x1", "ß", "delta", "é", "omega", "日本", "rare"]
    weights = np.array([30, 20, 10, 8, 6, 4, 3, 2, 2, 1]) / 86
    made = [
        (int(i), " ".join(rng.choice(pool, size=rng.integers(1, 25), p=weights))) for i in range(120)
    ]
    copies = [(500 + i, "alpha beta gämma delta") for i in range(40)]
    return made + copies + [(r[0], r[1]) for r in odd_docs]


def test_result_equals_scoring_all_documents(spark, odd_docs, small_slices):
    docs = corpus(odd_docs)
    items = [
        (0, "Alpha beta, GÄMMA!"), (1, "rare 日本 é é"), (2, ""), (3, None), (4, "unknown words"), (0, "omega"),
        (None, "delta-delta x1"), (5, odd_docs[0][1]), (6, "?!"), (7, "one two"),
    ]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, docs, items, 3) == brute(docs, items, 3)


def test_usual_sizes(spark, odd_docs):
    docs = corpus(odd_docs)
    items = [(i, text[:200] if text else text) for i, text in docs[:30]]
    assert got(spark, docs, items) == brute(docs, items)


def test_strata_hold_equal_normalisers_in_bounded_slices(spark, odd_docs, small_slices):
    docs = corpus(odd_docs)
    index = build(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = index.slices.collect()
    assert sum(len(r["doc_ids"]) for r in rows) == sum(bool(terms(t)) for _, t in docs) == index.n_docs
    assert len([r for r in rows if r["m"] == rows[0]["m"]]) >= 1
    for r in rows:
        tfs = [r["run_tfs"][a:b] for a, b in zip(r["run_starts"], r["run_starts"][1:])]
        assert all(t == sorted(set(t), reverse=True) for t in tfs)
        assert sum(r["dfs"]) == len(r["posts"])


def test_visits_stop_at_the_bounds(spark, monkeypatch):
    """Slices that cannot reach the k-th best score are not scored."""
    visited = []
    plain = ranked._Stratum.scores
    best = ranked._Best(2)
    weights = np.array([5])
    import pyarrow as pa

    def stratum(m, tf, doc):
        return ranked._Stratum({
            "m": pa.scalar(m), "doc_ids": pa.scalar([doc], pa.list_(pa.int64())),
            "terms": pa.scalar(["a"]), "run_starts": pa.scalar([0, 1], pa.list_(pa.int32())),
            "run_tfs": pa.scalar([tf], pa.list_(pa.int32())), "post_starts": pa.scalar([0, 1], pa.list_(pa.int32())),
            "posts": pa.scalar([0], pa.list_(pa.int32())),
        }, pa.array(["a"]), weights)

    monkeypatch.setattr(ranked._Stratum, "scores", lambda s, *a: visited.append(s) or plain(s, *a))
    strata = [stratum(10, 1, 1), stratum(10, 9, 2), stratum(10, 9, 3), stratum(10, 9, 0), stratum(500, 1, 4)]
    ranked._visit(strata, [best], [np.array([0])], weights)
    assert best.ids.tolist() == [0, 2] and len(visited) == 3  # equal bounds are visited, lower ones are not


def test_odd_tables(spark, odd_frame, empty_frame):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    clash = items.selectExpr("*", "1 AS doc_id", "2 AS rank", "3 AS score", "4 AS item")
    rows = search(build(odd_frame), clash)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    assert [r["doc_id"] for r in rows.orderBy("rank").collect()] == [12, 13, 3]  # document 3 holds "one"
    assert search(build(empty_frame), items).count() == 0
    assert search(build(odd_frame), items.limit(0)).schema == rows.schema
