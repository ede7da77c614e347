import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from marketloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.WordwiseEncoder(PATH)


def test_ids_are_the_tokenizers(encoder, words):
    texts = [
        words(1, 300), words(2, 40).upper(), "it's DON'T we'll 12³½ ...", "", " \n\t", "<|endoftext|> x", "a\x1cb",
        "ΣΑΣ ΟΔΟΣ", "é  ̈x", "İstanbul ǅ", "日本語 👍🏽", "z" * 3000, "a" * 47 + " " + "b" * 48 + " " + "c" * 49,
        " a b　c", "naïve café ſ", "x\u0000y", "1234567890" * 10,
    ]
    for text in texts:
        split = encoder.split(text)
        encoder.learn(split)
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text, split), "<u4").tolist() == want, text


def test_fullest_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        room = rng.randint(0, 60)
        chosen = packing.fullest(Counter(lengths), room)
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums if s + n <= room}
        assert sum(n * k for n, k in chosen.items()) == max(sums)
        assert all(k <= Counter(lengths)[n] for n, k in chosen.items())


def first_fit(lengths, capacity):
    """Bins of first fit by falling length, the usual yardstick."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= n), None)
        if at is None:
            rooms.append(capacity)
            at = len(rooms) - 1
        rooms[at] -= n
    return len(rooms)


def test_plan_uses_every_length_once():
    rng = random.Random(4)
    counts = {n: rng.randint(1, 50) for n in rng.sample(range(1, 101), 60)} | {100: 7}
    bins = packing.plan_bins(counts, 100)
    used = Counter()
    for chosen, times in bins:
        assert sum(n * k for n, k in chosen.items()) <= 100
        used.update({n: k * times for n, k in chosen.items()})
    assert used == Counter(counts)
    lengths = [n for n, c in counts.items() for _ in range(c)]
    assert -(-sum(lengths) // 100) <= sum(t for _, t in bins) <= 1.03 * first_fit(lengths, 100)


def test_odd_rows_are_packed_whole(spark, odd_docs, odd_frame, empty_frame, encoder):
    rows = packing.pack(odd_frame, PATH, capacity=256).collect()
    want = Counter()
    for doc in odd_docs:
        ids = encoder.tokenizer.encode(doc[1] or "", add_special_tokens=False).ids + [1]
        for piece, low in enumerate(range(0, len(ids), 256)):
            part = ids[low:low + 256]
            want[doc[0], piece, low, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= first_fit([r.length for r in rows], 256) + 1
    assert packing.pack(empty_frame, PATH).collect() == []
