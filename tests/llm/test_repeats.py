import hashlib
import random

import numpy as np
import pytest

from marketloom.llm import repeats, suffixes
from marketloom.llm.anchors import WINDOW, find_anchors


def plain_report(docs):
    """Every window of every text in order, against a set of the windows before."""
    seen, out = {}, {}
    for doc, text in sorted(docs):
        body = (text or "").encode()
        gone = np.zeros(len(body) + 1, int)
        for at in range(len(body) - WINDOW + 1):
            if seen.setdefault(body[at:at + WINDOW], (doc, at)) != (doc, at):
                gone[at] += 1
                gone[at + WINDOW] -= 1
        removed = np.cumsum(gone)[:len(body)] > 0
        kept = bytes(np.frombuffer(body, np.uint8)[~removed])
        spans = int((np.diff(removed.astype(int), prepend=0) == 1).sum())
        out[doc] = (len(body), int(removed.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def report(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: tuple(r)[1:] for r in repeats.repeat_report(frame).collect()}


@pytest.fixture(scope="module")
def tangled(words):
    """Passages shared in many ways, periodic texts, overlaps inside one text, copies."""
    rng = random.Random(5)
    shared = [words(100 + i, 30) for i in range(6)]
    docs = []
    for doc in range(60):
        parts = [words(1000 + doc, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            piece = rng.choice(shared)
            low = rng.randint(0, 60)
            parts += [piece[low:low + rng.randint(60, 200)], words(5000 + doc * 9 + len(parts), rng.randint(0, 5))]
        docs.append((doc, "".join(parts)))
    docs += [(70, "ab" * 300), (71, "x" * 99), (72, "x" * 250), (73, "x" * 100), (74, docs[3][1]),
             (75, "é" * 120), (76, "yé" + "é" * 90), (77, ""), (78, docs[3][1] * 2)]
    return docs


def test_equals_brute_force(spark, tangled):
    assert report(spark, tangled) == plain_report(tangled)


def test_frequent_anchors_give_the_same(spark, tangled, monkeypatch):
    monkeypatch.setattr(repeats, "SAMPLE_SHARE", 1)
    monkeypatch.setattr(repeats.frequent_anchors, "__defaults__", (1,))
    monkeypatch.setattr(repeats, "FREQUENT_AT_LEAST", 2)
    keyed = repeats._keyed(spark.createDataFrame(tangled, "doc_id long, text string"))
    assert len(repeats.frequent_anchors(keyed)) > 10
    assert report(spark, tangled) == plain_report(tangled)


def test_small_chunks_give_the_same(spark, tangled, monkeypatch):
    monkeypatch.setattr(repeats, "_CHUNK_BYTES", 700)
    assert report(spark, tangled) == plain_report(tangled)


def test_equal_windows_choose_the_same_anchor(words):
    text = words(3, 400).encode()
    passage = text[500:500 + WINDOW]
    other = words(4, 50).encode() + passage + words(5, 50).encode()

    def anchors(body, low):
        buffer = np.frombuffer(body + bytes(16), np.uint8)
        found = find_anchors(buffer, np.array([0]), np.array([len(body)]))
        return {int(a) - low for a in found if low <= a <= low + WINDOW - 56}

    assert anchors(text, 500) & anchors(other, other.index(passage))


def test_maximal_repeats_have_all_occurrences(words):
    passage = words(8, 30).encode()[:120]
    bodies = [b"a" + passage + b"q", b"b" + passage + b"r", b"c" + passage[:110] + b"s"]
    buffer = np.frombuffer(b"\0".join([*bodies, bytes(512)]), np.uint8)
    lengths = np.array([len(b) for b in bodies])
    ends = np.cumsum(lengths + 1) - 1
    nodes, order = suffixes.maximal_repeats(buffer, ends - lengths, ends, 100, 256)
    got = {int(n): sorted(order[a:b + 1].tolist()) for n, a, b in nodes}
    starts = (ends - lengths + 1).tolist()
    assert got == {120: starts[:2], 110: starts}


def test_only_suffixes_that_can_start_a_repeat_are_sorted():
    """Few letters, so repeats overlap: nodes against a comparison of all positions, and what was sorted."""
    rng, least = np.random.default_rng(7), 9
    bodies = [bytes(rng.integers(97, 99, 60).astype(np.uint8)) for _ in range(30)] + [b"cccccccccab", b"cccccccccab", b""]
    buffer = np.frombuffer(b"\0".join([*bodies, bytes(128)]), np.uint8)
    lengths = np.array([len(b) for b in bodies])
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    want = {}
    for low, body in zip(starts.tolist(), bodies):
        for i in range(len(body)):
            for j in range(i + least, len(body) + 1):
                want.setdefault(body[i:j], []).append((low + i, body[i - 1:i], body[j:j + 1]))
    # the longest of each set of places, if not all have the same byte before them
    want = {(len(t), tuple(sorted(p for p, _, _ in at))) for t, at in want.items() if len(at) > 1 and (
        len({b for _, b, _ in at}) > 1 or b"" in {b for _, b, _ in at}) and (
        len({a for _, _, a in at}) > 1 or b"" in {a for _, _, a in at})}
    nodes, order = suffixes.maximal_repeats(buffer, starts, ends, least, 64)
    assert {(int(n), tuple(sorted(order[a:b + 1].tolist()))) for n, a, b in nodes} == want
    assert set(order.tolist()) <= {p for _, at in want for p in at}
    line = bytes(range(128, 248))
    bodies = [bytes([65 + i]) + line for i in range(40)]
    buffer = np.frombuffer(b"\0".join([*bodies, bytes(512)]), np.uint8)
    ends = np.cumsum(np.full(40, 122)) - 1
    nodes, order = suffixes.maximal_repeats(buffer, ends - 121, ends, 100, 256)
    assert nodes.tolist() == [[120, 0, 39]] and len(order) == 40


def test_odd_rows(spark, odd_docs, odd_frame, empty_frame):
    rows = repeats.repeat_report(odd_frame).collect()
    assert len(rows) == len(odd_docs)
    want = plain_report({(d[0] if d[0] is not None else 10**9, d[1]) for d in odd_docs})
    for row in rows:
        assert tuple(row)[1:] == want[row.doc_id if row.doc_id is not None else 10**9]
    assert repeats.repeat_report(empty_frame).collect() == []
    cut = repeats.without_repeats(odd_frame)
    assert cut.columns == odd_frame.columns and cut.count() == len(odd_docs)
    left = {r.doc_id: r for r in cut.collect()}
    assert left[5].text is None and left[2].text == "" and left[2].n_chars == 0
    assert left[8].n_chars == len(left[8].text)


def test_texts_without_id_are_told_apart(spark, words):
    """Two texts with one 32-bit hash: the first keeps all, the other loses only what they share."""
    from pyspark.sql import functions as F

    pair = spark.range(400_000).select(F.concat(F.lit(words(1, 40)), F.sha2(F.col("id").cast("string"), 256)).alias("t")).groupBy(
        F.hash("t").alias("h")).agg(F.collect_list("t").alias("ts")).filter("size(ts) > 1").first()["ts"]
    docs = spark.createDataFrame([(None, t) for t in pair], "doc_id long, text string")
    shared = sorted(r.n_removed for r in repeats.repeat_report(docs).collect())
    assert shared[0] == 0 and 0 < shared[-1] < len(pair[0])


@pytest.mark.parametrize("most", [1, 8])
def test_divided_anchors_give_the_same(spark, tangled, words, monkeypatch, most):
    """Anchors with more contexts than are searched together; a line that each text has in other surroundings."""
    monkeypatch.setattr(repeats, "GROUP_CONTEXTS", most)
    line = words(77, 40)[:130]
    docs = tangled + [(200 + i, words(300 + i, 20) + line[:100 + i % 30] + words(600 + i, 20)) for i in range(60)]
    assert report(spark, docs) == plain_report(docs)


def test_rows_of_a_common_line_grow_no_faster_than_its_contexts(spark, words, monkeypatch):
    line, rows, plain = words(77, 40)[:130], {}, repeats.written

    def counted(df, label):
        out = plain(df, label)
        rows[label] = max(rows.get(label, 0), out.count())
        return out

    monkeypatch.setattr(repeats, "written", counted)
    monkeypatch.setattr(repeats, "SAMPLE_SHARE", 1)
    monkeypatch.setattr(repeats.frequent_anchors, "__defaults__", (1,))
    monkeypatch.setattr(repeats, "GROUP_CONTEXTS", 20)
    docs = [(i, words(300 + i, 20) + line + words(600 + i, 20)) for i in range(100)]
    assert report(spark, docs) == plain_report(docs)
    of_step_3 = {label: n for label, n in rows.items() if label not in ("settled", "contexts")}
    assert max(of_step_3.values()) <= 4 * rows["contexts"], rows
