import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import forest, vector_links

SCHEMA = "vec_id long, embedding array<float>, label int, node int, space int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def plain_links(rows, threshold=0.98):
    taking = [
        (at, i, np.array(v, np.float32).astype(float), lab) for at, (i, v, lab) in enumerate(rows)
        if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)
    ]
    links = {at: 0 for at in range(len(rows))}
    parent = {at: at for at in links}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, _, v, lab) in enumerate(taking):
        for b, _, w, lab2 in taking[:n]:
            if lab == lab2 and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for at, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(at)] = min(least.get(find(at), i), i)
    return sorted(
        ((i, links[at], least.get(find(at)), i is not None and i == least.get(find(at)))
         for at, (i, *_) in enumerate(rows)), key=repr,
    )


@pytest.fixture(scope="module")
def clustered():
    """Near copies around centres in two labels, exact copies, scaled copies, odd rows."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        v = centres[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3])
        rows.append((i, v.tolist(), i % 3 % 2))
    rows += [(1000 + i, rows[7][1], 1) for i in range(30)]
    rows += [(2000, (np.array(rows[7][1]) * 50).tolist(), 1), (2001, rows[7][1], None), (2002, None, 1),
             (2003, [0.0] * 16, 1), (2004, [float("nan")] * 16, 1), (2005, [None] + [1.0] * 15, 1),
             (2006, [float("inf")] + [1.0] * 15, 1), (2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1),
             (None, rows[8][1], 0), (3, rows[3][1], 0), (2009, [], 1), (2010, [1e-30] * 16, 1), (2011, [1e30] * 16, 1)]
    return rows


@pytest.mark.parametrize("block", [1 << 19, 1 << 13])
def test_links_equal_brute_force(spark, clustered, monkeypatch, block):
    monkeypatch.setattr(vector_links, "BLOCK_BYTES", block)
    got = vector_links.near_duplicates(frame(spark, clustered)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_links(clustered)
    assert sum(r.n_links for r in got) > 1000


def test_bounds_hold():
    rng = np.random.default_rng(4)
    rows = vector_links.unit(rng.normal(size=(200, 33)))
    q, scale, lost, kept = vector_links.quantised(rows)
    near = vector_links.products(q, q) * (scale[:, None] * scale)
    assert (np.abs(rows @ rows.T - near) <= lost[:, None] * kept + lost + 1e-12).all()


def test_no_rows(spark):
    assert vector_links.near_duplicates(frame(spark, [])).collect() == []
    assert forest.search(frame(spark, []), F.col("vec_id") % 100 == 0).collect() == []


def plain_nearest(rows, query, count=10):
    own = [v for i, v, _ in rows if i == query and v]
    base = min(np.array(v, np.float32).astype(float).tolist() for v in own)
    best = {}
    for i, v, _ in rows:
        ok = i is not None and i != query and v and None not in v and np.isfinite(v).all() and any(v)
        if ok and len(v) == len(base):
            gap = np.array(v, np.float32).astype(float) - base
            score = np.sqrt((gap * gap).sum())
            best[i] = min(best.get(i, np.inf), score)
    return sorted((s, i) for i, s in best.items())[:count]


def test_search_finds_the_nearest(spark, clustered):
    rows = frame(spark, clustered)
    got = forest.search(rows, rows.vec_id % 100 == 0).collect()
    hits = total = 0
    for query in {r.query_id for r in got}:
        own = sorted((r for r in got if r.query_id == query), key=lambda r: r["rank"])
        want = plain_nearest(clustered, query)
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and len(own) == len(want)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & {i for _, i in want})
        total += len(want)
    assert {r.query_id for r in got} == {0, 100, 200, 300, 1000, 2000}
    assert hits / total >= 0.9


def test_whole_forest_is_exact_with_small_slices(spark, clustered, monkeypatch):
    monkeypatch.setattr(forest, "SLICE_ROWS", 5)
    rows = frame(spark, clustered)
    got = forest.search(rows, rows.vec_id == 1000, share=99.0, leaf_rows=16).collect()
    own = [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])]
    want = plain_nearest(clustered, 1000)
    assert [i for _, i in own] == [i for _, i in want]
    assert np.allclose([s for s, _ in own], [s for s, _ in want], rtol=0, atol=1e-12)


@pytest.mark.parametrize("kind, labels", [("long", [1, 1 + (1 << 40), -1, -(1 << 62)]), ("string", ["a", "b", "a:1", ""])])
def test_links_stay_within_labels_of_any_type(spark, kind, labels):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=8)
    rows = [
        (10 * at + i, (centre + 0.01 * rng.normal(size=8)).tolist(), label) for at, label in enumerate(labels) for i in range(3)
    ]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_links.near_duplicates(df).collect()}
    assert got == {i: (2, i // 10 * 10) for i, _, _ in rows}
