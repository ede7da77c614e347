"""Large Arrow batches are worked on in parts, and few names need no grams."""

import numpy as np
import pandas as pd

from marketloom.functions.sentiment import SCORE_COLUMNS
from marketloom.operators import embedding as em
from marketloom.operators import reporting as rp
from marketloom.operators import sentiment as sn
from marketloom.operators import similarity as sm


def test_scorers_get_bounded_batches(spark):
    def make():
        def score(texts):
            return pd.DataFrame([(str(len(texts)), 0.0, 0.0, 1.0, 0.0)] * len(texts), columns=["label", *SCORE_COLUMNS])
        return score

    rows = spark.range(3000).selectExpr("id", "cast(id as string) AS headline").coalesce(1)
    scored = sn.score_with(rows, make).collect()
    assert sorted(r.id for r in scored) == list(range(3000))
    assert max(int(r.label) for r in scored) <= 1024


def test_vectors_and_hits_over_many_parts(spark):
    docs = spark.createDataFrame([(i, [i % 7, i % 5]) for i in range(2500)], "vec_id bigint, slots array<int>").coalesce(1)
    vectors = em.embed(docs, [1.0 + i for i in range(7)])
    got = {r.vec_id: list(r.embedding) for r in vectors.collect()}
    want = {i: np.bincount([i % 7, i % 5], minlength=7) * np.arange(1.0, 8.0) for i in range(2500)}
    assert len(got) == 2500 and all(np.allclose(got[i], want[i]) for i in got)
    asked = vectors.filter("vec_id IN (3, 2499)").withColumnRenamed("vec_id", "query_id")
    hits = sm.search(sm.build(vectors), asked, 3).collect()
    best = {q: sorted(i for i in want if np.allclose(want[i], want[q]))[:3] for q in (3, 2499)}
    for q, ids in best.items():
        assert [r.vec_id for r in sorted(hits, key=lambda r: r["rank"]) if r.query_id == q] == ids


def test_few_names_are_compared_directly(spark, monkeypatch):
    labels, plain = [], rp.written
    monkeypatch.setattr(rp, "written", lambda df, label: (labels.append(label), plain(df, label))[1])
    names = spark.createDataFrame([("A", "alpha"), ("B", "beta"), ("C", "gamma")], "symbol string, name string")
    texts = spark.createDataFrame([("alphq",), ("customer#000000017",), ("bet",), ("gamma",)], "text string")
    direct = sorted(map(tuple, rp.nearest_names(texts, names).collect()))
    assert "grams" not in labels
    monkeypatch.setattr(rp, "FEW_NAMES", 0)
    assert sorted(map(tuple, rp.nearest_names(texts, names).collect())) == direct and "grams" in labels
