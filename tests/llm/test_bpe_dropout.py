import public_tokenizers
import pytest
import sentencepiece

from marketloom.llm import bpe_dropout

PATH = public_tokenizers.path("piece_bpe_32k.model")


def ids_of(encoder, text, doc_id=1):
    words = encoder.words(text)
    picks = encoder.variant_of(doc_id, len(words))
    encoder.learn(words, picks)
    return encoder.encode(words, picks)


@pytest.fixture(scope="module")
def texts(words):
    return [words(1, 200), "  two  spaces\n\nlines\t", " ", "日本語 🤗 ▁ mixed ▁▁ x", "aaaa" * 60, "<s> \x00\x01", "é" * 50]


def test_without_dropout_it_is_the_library(texts):
    encoder = bpe_dropout.Encoder(PATH, 1, 0.0, 1)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in texts:
        if "▁" not in text:  # the library cannot tell this character from a space
            assert memoryview(ids_of(encoder, text)).cast("I").tolist() == library.encode(text)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_round_trip_and_seeds(texts, dropout):
    found = []
    for seed in (1, 1, 2):
        encoder = bpe_dropout.Encoder(PATH, seed, dropout, 4)
        found.append([ids_of(encoder, t) for t in texts])
        assert [encoder.decode(i) for i in found[-1]] == texts
    assert found[0] == found[1]
    assert (found[0] != found[2]) == (0 < dropout < 1)


def test_batches_equal_the_agenda(words):
    encoder = bpe_dropout.Encoder(PATH, 9, 0.3, 3)
    ids_of(encoder, words(4, 600))
    for variant, known in enumerate(encoder.known):
        for word, ids in known.items():
            assert encoder.by_agenda(word, encoder.key(word, variant)) == ids


def test_odd_rows(spark, odd_docs, odd_frame, empty_frame):
    rows = bpe_dropout.encoded(odd_frame, PATH)
    got = sorted((r.doc_id or -1, r.n_ids, r.ids_crc32, r.lossless) for r in rows.collect())
    assert len(got) == len(odd_docs) and all(r[3] for r in got)
    again = bpe_dropout.encoded(odd_frame.repartition(3), PATH, with_ids=False)
    assert sorted((r.doc_id or -1, r.n_ids, r.ids_crc32, r.lossless) for r in again.collect()) == got
    back = sorted(bpe_dropout.decoded(rows, PATH).collect(), key=repr)
    assert back == sorted([(d[0], d[1]) for d in odd_docs], key=lambda r: repr(back[0].__class__(doc_id=r[0], text=r[1])))
    assert bpe_dropout.encoded(empty_frame, PATH).collect() == []


def test_the_query_returns_ids_that_decode(spark):
    from marketloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op9_bpe_dropout"](spark, folder)
    told = {(r.doc_id, r.text) for r in bpe_dropout.decoded(rows, PATH).collect()}
    assert told == {(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
