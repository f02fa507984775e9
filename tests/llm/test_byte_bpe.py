import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from seamline.llm import byte_bpe

PIECES = ["'", "s", "t", "re", "r", "e", "v", "l", "d", "m", " ", "  ", "\n", "\t", " ", "　", "A", "é", "汉", "1", "½", "!", "...", "<|endoftext|>", "\U0001f642", "\x1c", "\x85", "'ll", "'ve", "the ", "and "]


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks
    return tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_text_goes_up_the_tree_and_windows_grow_until_stable(library):
    c = byte_bpe.TreeCodec(byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks, P.PATTERN, leaf=8)
    for text in ("internationalisation of tokenisation", "x" * 500, "nowhitespace" * 40):
        joins, grown = c.joins, c.grown
        assert c.encode(text) == library.encode_ordinary(text)
        assert c.joins > joins and c.grown > grown
        c.known.clear()
    assert c.merged("tokenisation".encode()) == library.encode_ordinary("tokenisation")


def test_joins_equal_the_library_and_decode_back(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(120))) for _ in range(1500)]
    texts += ["a" * 3000, "ab" * 1500, " " * 999, "!" * 999, "", " ", "'r", "".join(rng.choice("abcdeirt") for _ in range(3000))]
    for leaf in (1, 2, 7, 50, 4096):
        c = byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, leaf)
        for t in texts:
            ids = c.encode(t)
            assert ids == library.encode_ordinary(t)
            assert c.decode(ids) == t.encode()


def test_query_with_odd_rows(spark, library):
    ranks = P.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (2, "abc def", "z"), (None, "naïve " * 2000, "z")], "doc_id long, text string, ids string")
    got = {(r.doc_id, r.n_tokens): (r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(docs, ranks, P.PATTERN, leaf=64).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for doc, text in ((1, ""), (2, "abc def"), (None, "naïve " * 2000)):
        ids = library.encode_ordinary(text)
        assert got[doc, len(ids)] == (sha(" ".join(map(str, ids)).encode()), sha(text.encode()))
    assert len(got) == 4


def test_texts_without_blanks_take_time_in_proportion(library):
    import base64
    import time

    rng = random.Random(3)
    texts = ["漢" * 300_000, "a" * 300_000, base64.b64encode(rng.randbytes(200_000)).decode(), "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(60_000)), " " * 200_000 + "x"]
    c = byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    start = time.time()
    got = [c.encode(t) for t in texts]
    assert time.time() - start < 30
    assert [x for x, t in zip(got, texts) if x != library.encode_ordinary(t)] == []
