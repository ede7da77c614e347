import random

import numpy as np
import pytest
import xxhash

from marketloom.llm import components, simhash


def plain_fingerprint(text):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i:i + 4]) for i in range(max(1, len(parts) - 3))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, codes, radius):
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for at, a in enumerate(ids):
        for b in ids[:at]:
            if (codes[a] ^ codes[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: find(i) for i in ids}


def test_fingerprint_equals_brute_force(words):
    for text in (None, "", " \t", "One", "one two THREE", words(1, 50), "Ä b C d É f", "a\x0bb\x0cc d e"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6])
def test_every_link_is_found_in_small_shards(spark, radius):
    rng = random.Random(radius)
    codes = [rng.getrandbits(64) for _ in range(300)]
    for code in codes[:120]:
        for _ in range(rng.randint(1, 3)):
            flipped = code
            for bit in rng.sample(range(64), rng.randint(1, radius + 2)):
                flipped ^= 1 << bit
            codes.append(flipped)
    codes = sorted(set(codes))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    nodes = spark.createDataFrame([(c,) for c in signed], "code long")
    links = simhash.fingerprint_links(nodes, radius, shard_points=40, sample_points=100).collect()
    of = dict(zip(signed, codes))
    assert all((of[r.a] ^ of[r.b]).bit_count() for r in links)
    at = {c: i for i, c in enumerate(signed)}
    found = components.roots(
        np.arange(len(codes)), np.array([at[r.a] for r in links], int),
        np.array([at[r.b] for r in links], int),
    )
    want = plain_components(list(range(len(codes))), codes, radius)
    assert found.tolist() == [want[i] for i in range(len(codes))]


def test_dense_group_yields_a_forest():
    codes = np.array([(1 << i) | (1 << j) for i in range(40) for j in range(i)], np.uint64)
    (mask, *_), masked = simhash.masks_for(4)
    parent = simhash.linked_in_shard(np.sort(codes), mask, masked, 4)
    assert set(parent) == {0} and len(parent) == len(codes)


def test_odd_rows(odd_docs, odd_frame, empty_frame):
    rows = simhash.near_duplicates(odd_frame).collect()
    assert len(rows) == len(odd_docs)
    ids = sorted({d[0] for d in odd_docs if d[0] is not None})
    codes = {d[0]: plain_fingerprint(d[1]) for d in odd_docs}
    want = plain_components(ids, codes, 4)
    for row in rows:
        if row.doc_id is not None:
            assert int(row.fingerprint, 16) == codes[row.doc_id]
            assert row.component_id == want[row.doc_id]
        else:
            assert row.component_id == 1
    assert {r.component_id for r in rows if r.doc_id in (4, 5, 6)} == {4}
    assert simhash.near_duplicates(empty_frame).collect() == []


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(900, i) for i in range(500, 520)]
    links = spark.createDataFrame([*path, *star, (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.labelled(links).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 500 for i in [*range(501, 520), 900]}
