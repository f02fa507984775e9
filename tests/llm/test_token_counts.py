import random

import public_tokenizers
from tokenizers import Tokenizer

from seamline.llm import token_counts

PIECES = ["'", "s", "t", "re", "r", "e", "v", "l", "d", "m", " ", "  ", "\n", "\t", " ", "　", "A", "é", "汉", "1", "½", "!", "...", "<|endoftext|>", "\U0001f642", "\x1c", "\x85", "'ll", "'ve", "'re", "the", "tion"]


def texts():
    rng = random.Random(4)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(80))) for _ in range(1500)]
    return out + ["a" * 3000, "ab" * 1500, " " * 1200, "!" * 999, "", " ", "'r", "'", "x'r", "x  'l y", "word " * 3000]


def test_counts_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts()]
    assert token_counts.counter(path).batches(texts()).tolist() == want


def test_cutter_maps_compose_over_any_chunks():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    c = token_counts.Counter(path)
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts()]
    for chunk in (1, 2, 3, 7, 64):
        c.cutter.CHUNK, c.cutter.TAIL = chunk, 2
        assert c.batches(texts()).tolist() == want
    c.merger.LIMIT = 50  # the table starts anew again and again
    c.BATCH = 200
    assert c.batches(texts()).tolist() == want


def test_query_with_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "a b", 5), (None, "héllo world " * 400, 5)], "doc_id long, text string, n_tokens long")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path).collect())
    long = len(Tokenizer.from_file(path).encode("héllo world " * 400, add_special_tokens=False).ids)
    assert got == [("1", 0, 0, False), ("2", 0, 0, False), ("2", 3, 2, False), ("None", 13 * 400, long, long > 512)]
    assert token_counts.token_counts(docs.limit(0), path).count() == 0
