import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridspark.llm import token_blocks as B

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, World. It's a TEST, don't. ..., a.,b 'll", None, "", " \n ", "été ÉTÉ ét. <|endoftext|>x", "x\xa0y\tz\x1cq", "ΣΑΣ. ß, ́a", "w " * 9000, "字 漢字.", ",", "."]


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 2**32 - 1])
def test_blocks_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint32)
    ids[::97] = 2**32 - 1
    stored = {k: v.tobytes() for k, v in B.encode(ids).items()}
    assert (B.decode(stored, n) == ids).all()
    if n > 3072:
        assert (B.decode(stored, n, slice(1, 3)) == ids[1024:3072]).all()
        assert (B.decode(stored, n, slice(4, 5)) == ids[4096:]).all()


def test_documents_match_the_library(spark, docs, tmp_path):
    pairs = [(7 * i % 11, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (None, "no id")]
    tokenizer = Tokenizer.from_file(PATH)
    B.write_blocks(B.encode_blocks(docs(pairs), PATH, 2, by_chunk=True, partitions=3), str(tmp_path / "blocks"))
    got = sorted(B.read_documents(spark, str(tmp_path / "blocks")).collect(), key=lambda r: r.start)
    want = sorted(pairs, key=lambda p: (p[0] is not None, p[0], p[1] is not None, p[1]))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    at = 0
    for row, (_, text) in zip(got, want, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (row.start, row.n_tokens, row.ids_crc32, bytes(row.ids)) == (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4


def test_small_cache_and_whole_texts_agree():
    small, whole = B.Encoder(PATH, True, cache_words=2), B.Encoder(PATH, False)
    texts = [t or "" for t in TEXTS]
    assert small(texts) == whole(texts) and len(small) <= 3


@pytest.mark.parametrize("by_chunk", [True, False])
def test_cased_tokenizer_keeps_capitals(by_chunk):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    encoder = B.Encoder(path, by_chunk)
    assert not (encoder.by_chunk or encoder.lowers)
    texts = ["The THE Brown", "a  b\nC", "ÉTÉ été ΣΑΣ", "end. End, 12", *[t or "" for t in TEXTS]]
    assert encoder(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_shortcuts_hold_for_the_tokenizer_of_the_query():
    encoder = B.Encoder(PATH, True)
    assert encoder.by_chunk and encoder.plain and encoder.lowers and encoder.splits


def test_empty_table(spark, docs, tmp_path):
    B.write_blocks(B.encode_blocks(docs([]), PATH, 2), str(tmp_path / "none"))
    assert B.read_documents(spark, str(tmp_path / "none")).collect() == []
