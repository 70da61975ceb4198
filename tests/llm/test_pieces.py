import random

import public_tokenizers
import pytest
import sentencepiece

from scanloom.llm.pieces import PieceEncoder, PieceVocabulary, decode_pieces, encode_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_as_the_library(library):
    rnd = random.Random(1)
    parts = ["a", "aa", "the", " ", "  ", "\n", "▁", "é", "日", "\U0001f600", "\t", "\x00", "er", "ion", "ab", "!!", "1", "<s>", "<0x0A>", "ing", "A", "́"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(4000)] + ["", "a" * 3000, "ab" * 999, " " * 77]
    ids = PieceEncoder(PieceVocabulary(MODEL), table_words=500).encode(texts)
    assert ids.to_pylist() == library.encode(texts)
    assert PieceVocabulary(MODEL).decode(ids) == library.decode(library.encode(texts))


def test_decoding_any_ids(library):
    import pyarrow as pa

    rnd = random.Random(2)
    ids = [[rnd.randint(3, 400) for _ in range(rnd.randint(0, 9))] for _ in range(2000)]
    assert PieceVocabulary(MODEL).decode(pa.array(ids, pa.list_(pa.int32()))) == [library.decode(x) for x in ids]


def test_awkward_and_empty(docs_of, awkward, library):
    out = decode_pieces(encode_pieces(docs_of(awkward), MODEL), MODEL).collect()
    want = sorted(((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in awkward), key=str)
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in out), key=str) == want
    assert decode_pieces(encode_pieces(docs_of([]), MODEL), MODEL).count() == 0


def test_null_lists(spark):
    out = decode_pieces(spark.createDataFrame([(1, None), (2, [306, 264])], "doc_id long, ids array<int>"), MODEL).collect()
    assert {r["doc_id"]: r["decoded"] for r in out} == {1: "", 2: "th a"}


def test_one_worker_to_a_task(docs_of, awkward):
    """Encoding and decoding together are one Python step, with the rows of the two."""
    import corpus_pipeline
    from scanloom.llm.pieces import encode_and_decode

    docs = docs_of(awkward)
    out = encode_and_decode(docs, MODEL)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(out) == rows(decode_pieces(encode_pieces(docs, MODEL), MODEL))
    for plan in (out, corpus_pipeline.sentencepiece(docs.sparkSession, docs, "")):
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
