"""Near-duplicate removal against the greedy rule written out in Python."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import dedupe


def jaccard(a, b):
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x and y else 0.0


def greedy_drops(texts, threshold, span):
    dropped = set()
    for i in range(len(texts)):
        if i in dropped:
            continue
        for j in range(i + 1, min(i + span + 1, len(texts))):
            if j not in dropped and jaccard(texts[i], texts[j]) >= threshold:
                dropped.add(j)
    return dropped


def drops_from_edges(edges, n):
    before = {}
    for i, j in edges:
        before.setdefault(j, set()).add(i)
    kept = set()
    for j in range(n):
        if not before.get(j, set()) & kept:
            kept.add(j)
    return set(range(n)) - kept


@pytest.mark.parametrize("seed,threshold", [(1, 0.5), (2, 0.7), (3, 0.95)])
def test_same_result_as_the_greedy_rule(spark, seed, threshold):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(6)]
    texts, seen = [], set()
    while len(texts) < 150:
        text = " ".join(rng.choices(words, k=rng.randint(3, 9))) + (" ." * rng.randint(0, 3))
        if text not in seen:
            seen.add(text)
            texts.append(text)
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, headline string")
    kept = dedupe.near_duplicates(rows, "headline", ["id"], threshold=threshold)
    got = {r["id"] for r in kept.select("id").collect()}
    assert got == set(range(150)) - greedy_drops(texts, threshold, 49)


@pytest.mark.parametrize("kind", ["copies", "two groups", "random", "gaps"])
def test_resolution_across_stretches(spark, kind):
    rng = random.Random(7)
    n, span = 400, 10
    if kind == "copies":
        edges = [(i, j) for j in range(n) for i in range(max(0, j - span), j)]
    elif kind == "two groups":
        group = [rng.randint(0, 2) for _ in range(n)]
        edges = [
            (i, j) for j in range(n) for i in range(max(0, j - span), j)
            if group[i] == group[j] != 0
        ]
    elif kind == "random":
        edges = [
            (i, j) for j in range(n) for i in range(max(0, j - span), j) if rng.random() < 0.25
        ]
    else:
        edges = [(i, i + 3) for i in range(0, n - 3, 40)] + [(395, 399)]
    pairs = spark.createDataFrame(edges, "i bigint, j bigint").repartition(5)
    dropped = dedupe.resolve(pairs, span=span, stretch_rows=32)
    assert {r["idx"] for r in dropped.collect()} == drops_from_edges(edges, n)


def random_masks(seed, n, span, share):
    rng = random.Random(seed)
    edges = [(i, j) for j in range(n) for i in range(max(0, j - span), j) if rng.random() < share]
    rows = pd.DataFrame(edges, columns=["i", "j"])
    masks = rows.assign(mask=[1 << (j - i - 1) for i, j in edges]).groupby("j")["mask"].sum()
    return edges, masks.reset_index()


def lines_of(masks, stretch, rows, span, limit=10_000):
    start = stretch * rows
    here = masks[(masks["j"] >= start - span) & (masks["j"] < start + rows)].assign(stretch=stretch)
    return dedupe._triples(dedupe._outcomes(here, span, rows, limit)["lines"].iloc[0])


def test_too_many_combinations_are_walked(spark):
    edges, masks = random_masks(3, 200, 8, 0.3)
    assert lines_of(masks, 3, 32, 8, limit=1) == []
    pairs = spark.createDataFrame(edges, "i bigint, j bigint")
    for limit in (1, 2, 4):
        dropped = dedupe.resolve(pairs, span=8, stretch_rows=16, combinations=limit)
        assert {r["idx"] for r in dropped.collect()} == drops_from_edges(edges, 200)


@pytest.mark.parametrize("seed", range(12))
def test_composed_stretches_are_one_longer_stretch(seed):
    """For every state that can come about, two composed stretches end as both walked in turn."""
    span, rows = 6, 9
    _, masks = random_masks(seed, 4 * rows, span, 0.12 + 0.03 * (seed % 4))
    parts = [lines_of(masks, k, rows, span) for k in range(4)]
    both, three = dedupe.compose(parts[2], parts[1], 10_000), None
    three = dedupe.compose(parts[3], both, 10_000)
    state = dedupe.apply_lines(parts[0], (1 << span) - 1)
    second = dedupe.apply_lines(parts[1], state)
    third = dedupe.apply_lines(parts[2], second)
    assert dedupe.apply_lines(both, state) == third
    assert dedupe.apply_lines(three, state) == dedupe.apply_lines(parts[3], third)
    assert dedupe.compose(parts[2], parts[1], 0) is None or len(dedupe._grouped(parts[2])[1]) == 0


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """One run of copies through 64 stretches: the scan doubles its reach."""
    n, span = 1024, 10
    edges = [(i, j) for j in range(n) for i in range(max(0, j - span), j)]
    written, seen = dedupe.written, []
    monkeypatch.setattr(dedupe, "written", lambda df, label: seen.append(label) or written(df, label))
    dropped = dedupe.resolve(spark.createDataFrame(edges, "i bigint, j bigint"), span=span, stretch_rows=16)
    assert {r["idx"] for r in dropped.collect()} == drops_from_edges(edges, n)
    assert seen.count("near-scan") <= 8


def test_distance_49_counts_and_50_does_not(spark):
    def texts(gap):
        fill = [f"filler text number {k} unlike {k * 7} others {k * 13}" for k in range(gap - 1)]
        return ["alpha beta gamma delta"] + fill + ["delta gamma beta alpha"]

    for gap, kept in ((49, 49), (50, 51)):
        rows = spark.createDataFrame(list(enumerate(texts(gap))), "id int, headline string")
        assert dedupe.near_duplicates(rows, "headline", ["id"]).count() == kept


def test_hash_dedupe_prefers_earlier_sources(spark):
    rows = spark.createDataFrame(
        [(1, 5, "Same Title"), (0, 9, " same title "), (1, 2, "other")],
        "priority int, id int, headline string",
    )
    kept = dedupe.by_hash(rows, "headline", F.col("priority"), [F.col("id")])
    assert {(r["priority"], r["id"]) for r in kept.collect()} == {(0, 9), (1, 2)}


def test_missing_column_raises(spark):
    with pytest.raises(ValueError):
        dedupe.clean_column(spark.range(1), "headline")


def test_marks_bound_the_union(spark):
    """No pair's bound is above its union, and it is close to it for sets that share little."""
    rng = random.Random(5)
    sets = [sorted({f"w{rng.randrange(300)}" for _ in range(n)}) for n in (0, 1, 40, 40, 150, 150)] + [["é", "w1"]]
    rows = spark.createDataFrame(list(enumerate(sets)), "i int, w array<string>").withColumn("bits", dedupe._bits_of(F.col("w")))
    marked = rows.select("i", "w", dedupe._marks(F.col("bits")).alias("m"))
    pairs = marked.toDF("i", "wi", "mi").crossJoin(marked.toDF("j", "wj", "mj")).select(
        "i", "j", (F.size("wj") + dedupe._only("mi", "mj")).alias("least"))
    for r in pairs.collect():
        union = len({*sets[r.i], *sets[r.j]})
        assert 0.8 * union <= r.least <= union
