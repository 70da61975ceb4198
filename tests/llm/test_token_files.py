import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from scanloom.llm.mixing_coder import decode_blocks, encode_blocks
from scanloom.llm.token_files import TokenFile, WordTokenizer, read_tokens, write_tokens

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("block", [1, 7, 128, 2048])
def test_coder_round_trip(block):
    rng = np.random.default_rng(block)
    cases = [[], [5], [0] * 700, rng.integers(0, 65536, 900), rng.integers(0, 3, 900), [65535] * 300, list(range(300)) * 3, rng.zipf(1.3, 1500) % 49408]
    for ids in cases:
        ids = np.array(ids, np.int64)
        blocks = encode_blocks(ids, block)
        assert [m for m, _ in blocks] == [min(block, len(ids) - k) for k in range(0, len(ids), block)]
        assert np.array_equal(decode_blocks(blocks), ids)
    assert sum(len(b) for _, b in encode_blocks(np.tile(np.arange(50), 100), 2048)) < 5000


def test_blocks_are_independent():
    ids = np.random.default_rng(1).integers(0, 500, 5000)
    blocks = encode_blocks(ids, 512)
    for k in (0, 3, 9):
        assert np.array_equal(decode_blocks([blocks[k]]), ids[k * 512 : k * 512 + 512])


def test_words_as_the_library(library):
    rnd = random.Random(5)
    parts = ["a", "the", "It's", " ", "  ", "\n", "\t", "\x1c", "\xa0", "é", "É", "日", "\U0001f600", "1", "23", "!!", ".", "'s", "<|endoftext|>", "İ", "Σ", "ΟΣ", "क़", "é", "ﬁ", "K", "\x00", "<", "|", "_", "ß"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(5000)]
    ids, counts = WordTokenizer(PATH).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_files(docs_of, awkward, library):
    manifest = write_tokens(docs_of(awkward), PATH)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in read_tokens(manifest, with_ids=True).collect()]
    start, want = 0, []
    for i, t in sorted(awkward, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert manifest.agg({"n_ids": "sum"}).first()[0] == start
    assert read_tokens(write_tokens(docs_of([]), PATH)).count() == 0


def test_damage_is_an_error(docs_of):
    from pyarrow import fs

    manifest = write_tokens(docs_of([(k, f"some words {k}") for k in range(50)]), PATH)
    path = manifest.first()["path"].removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[30] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        list(TokenFile(fs.LocalFileSystem().open_input_file(path)).documents(False))
