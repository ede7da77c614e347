import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm.alignment import Csr, alignment_links, alignment_report, byte_letters

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def tokens(libraries, text):
    """``(id, bytes)`` of both sides by the libraries, token by token."""
    tokenizer, model = libraries
    letters = byte_letters()
    a = [(i, bytes(letters[c] for c in tokenizer.id_to_token(i)))
         for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in model.encode(text):
        piece = model.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    good = text and b"".join(x for _, x in a) == whole and b"".join(x for _, x in b) == whole
    return (a, b) if good else ([], [])


def spans(side):
    out, at = [], 0
    for i, raw in side:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(libraries, docs):
    """All columns, by comparing every token of one side with every token of the other."""
    found, counts = [], Counter()
    for doc_id, text in docs:
        a, b = (spans(s) for s in tokens(libraries, text or ""))
        links = [(x[0], y[0]) for x in a for y in b if x[2] == y[2]]
        overlaps = sum(1 for x in a for y in b if x[1] < y[2] and y[1] < x[2])
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [
            [[str(t[0]) for t in side if low < t[2] <= high] for side in (a, b)]
            for low, high in zip([0, *cuts], cuts)
        ]
        text_of = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
        digest = hashlib.sha256(text_of.encode()).hexdigest() if a else ""
        shared = sum(len(x) * len(y) for x, y in groups)
        counts.update(links)
        found.append((doc_id, len(a), len(b), len(cuts), links, digest, overlaps, shared))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted(
        ((d, na, nb, g, len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), h, o, s)
         for d, na, nb, g, ls, h, o, s in found), key=repr
    )


def got(frame):
    return sorted((tuple(r) for r in alignment_report(frame, BYTES, P.PATTERN, PIECES).collect()), key=repr)


ODD = [
    "<|endoftext|> and <s> </s> <unk>", "  two  spaces\t\ttabs\n\n\nlines \r\n", "ﬁ ½ Ａ日本語テスト🙂🙂 x́",
    "don't we'll I'M 'S it's", "\x00\x01\x7f", "▁under ▁ bars", "naïve Zoë 12345 1,000.50", " ", " 　 wide", "a" * 5000,
]


def test_report_equals_comparing_all_tokens(spark, libraries, odd_docs):
    docs = [(r[0], r[1]) for r in odd_docs if r[1] is None or len(r[1]) < 20000]
    docs += [(100 + i, t) for i, t in enumerate(ODD)]
    docs = [d for d in docs if d[1] is None or len(d[1]) < 9000]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(frame) == brute(libraries, docs)


def test_very_long_text(spark, libraries, words):
    text = words(9, 20_000)
    row = got(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0]
    a, b = tokens(libraries, text)
    assert row[1:3] == (len(a), len(b)) and row[4] == row[3]


def test_odd_tables(spark, odd_frame, empty_frame):
    rows = alignment_report(odd_frame, BYTES, P.PATTERN, PIECES)
    assert rows.count() == odd_frame.count()
    zero = rows.filter("doc_id in (4, 5)").collect()
    assert [tuple(r)[1:] for r in zero] == [(0, 0, 0, 0, 0, 0, "", 0, 0)] * 2
    assert alignment_report(empty_frame, BYTES, P.PATTERN, PIECES).columns == rows.columns
    assert alignment_report(empty_frame, BYTES, P.PATTERN, PIECES).count() == 0


def test_links_are_those_of_the_ranges(spark, libraries):
    docs = [(1, "Retokenisation isn't trivial, naïvely"), (2, "12345 日本語"), (3, None)]
    rows = alignment_links(spark.createDataFrame(docs, "doc_id long, text string"), BYTES, P.PATTERN, PIECES)
    found = sorted(tuple(r) for r in rows.collect())
    want = []
    for doc_id, text in docs:
        a, b = (spans(s) for s in tokens(libraries, text or ""))
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                if (n := min(x[2], y[2]) - max(x[1], y[1])) > 0:
                    want.append((doc_id, "overlap", i, j, n))
                if np.searchsorted(cuts, x[2]) == np.searchsorted(cuts, y[2]):
                    want.append((doc_id, "group", i, j, 1))
    assert found == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=5, unique=True), min_size=1, max_size=6),
       st.lists(st.lists(st.integers(0, 6), max_size=4, unique=True), min_size=6, max_size=6))
def test_row_products_equal_dense_ones(left, right):
    def csr(rows, width):
        starts = np.cumsum([0, *map(len, rows)])
        return Csr(starts, np.array([c for r in rows for c in sorted(r)], np.int64), width)

    def dense(rows, width):
        out = np.zeros((len(rows), width), int)
        for i, r in enumerate(rows):
            out[i, r] = 1
        return out

    a, b = csr(left, 6), csr(right, 7)
    product = dense(left, 6) @ dense(right, 7)
    rows, columns, values = a.times(b)
    out = np.zeros_like(product)
    out[rows, columns] = values
    assert (out == product).all() and len(values) == (product > 0).sum()
    back = b.transposed
    assert (a.row_sizes_of_product(b) == product.sum(1)).all() and (dense(right, 7).sum(0) == np.diff(back.starts)).all()
