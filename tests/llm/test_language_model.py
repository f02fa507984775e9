"""Operator 12: counts and base scores by brute force, a normalised model, held-out gain."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import language_model as L


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w] + [None]


def brute(docs):
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in docs]
    counts = Counter(w for (_, t), h in zip(docs, held) if not h for w in words(lower(t)))
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, t), h in zip(docs, held):
        found = words(lower(t))
        base = math.fsum(math.log10((counts[w] + 1) / (n + v + 1)) for w in found)
        out.append((i, h, len(found), sum(counts[w] > 0 for w in found), n, round(base, 6)))
    return sorted(out, key=repr)


def corpus(rng, n, languages=3):
    """Texts in made-up languages, whose words follow one another by rules."""
    own = [[f"l{g}w{i}" for i in range(80)] for g in range(languages)]

    def text(k):
        g, at, out = rng.choice(own), rng.randrange(80), []
        for _ in range(k):
            at = (at * 3 + 1) % 80 if rng.random() < 0.7 else rng.randrange(80)
            out.append(g[at].title() if rng.random() < 0.1 else g[at] if rng.random() < 0.97 else f"rare{rng.randrange(10**6)}")
        return " ".join(out)

    return [(i, text(rng.randint(0, 80))) for i in range(n)]


def test_counts_and_base_scores(spark, tmp_path):
    docs = corpus(random.Random(1), 400)
    # null and empty texts, repeated rows and ids, null ids, other white space, a word and a text of great length, É
    docs += [(1000, None), (1001, ""), docs[3], (docs[4][0], "anders\x0bals vorher ja"), (None, "ohne nummer"), (1002, "x" * 300_000), (1003, "lang ist das " * 50_000), (1004, "É É é")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"row": F.lit("r"), "n": F.lit(0), "c": F.lit("c")})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for frequent in (1 << 16, 50):
        got = L.scored(spark.read.parquet(f"{tmp_path}/documents.parquet"), outputs=40, frequent=frequent, size=8)
        assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
        rows = got.collect()
        assert sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in rows), key=repr) == brute(docs)
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)


def test_better_than_single_words_on_held_out_texts(spark):
    docs = corpus(random.Random(2), 6000)
    rows = L.scored(spark.createDataFrame(docs, "doc_id bigint, text string"), outputs=400, size=16, rounds=4).where("held_out").collect()
    base, score = (sum(r[c] for r in rows) / sum(r["n_tokens"] for r in rows) for c in ("base_score", "score"))
    assert len(rows) > 500 and score > base + 0.3


def test_probabilities_sum_to_one(spark):
    docs = [(i, "a a a a b b b c c d d e f g h i j") for i in range(30)] + [(100, "k l m n o o p p")]
    counted = L.word_counts(spark.createDataFrame(docs, "doc_id bigint, text string"))
    v = L.Vocabulary.of(counted, outputs=3, frequent=11)
    c = {bytes(r["word"]): r["c"] for r in counted.collect()}
    model = L.Model.first(v.seen, 8)
    p = 10 ** model.log10(np.arange(v.n_outputs), np.tile([[2, 1]], (v.n_outputs, 1))).astype(float)
    share = 10 ** v.within()
    whole = sum(p[v.output[k]] * share[k] for k in v.number.values())
    rest = [n for w, n in c.items() if w not in v.number]
    assert len(rest) > 2 and v.n_outputs > 5
    whole += p[v.tail] * (sum(n + 1 for n in rest) + 1) / v.tail_total
    assert abs(p.sum() - 1) < 1e-5 and abs(whole - 1) < 1e-5


def test_same_figures_again(spark):
    docs = spark.createDataFrame(corpus(random.Random(4), 500), "doc_id bigint, text string").repartition(4, "doc_id")
    first, again = ({r["doc_id"]: r["score"] for r in L.scored(docs, outputs=50, size=8).collect()} for _ in range(2))
    assert first == pytest.approx(again, abs=1e-6)


@pytest.mark.parametrize("docs", [[], [(2, "nur zum prüfen"), (None, None)]])
def test_few_or_no_documents(spark, docs):
    rows = L.scored(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert len(rows) == len(docs) and all(math.isfinite(r["score"]) for r in rows)


def test_held_out_only(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = L.scored(spark.createDataFrame([(i, "ein text") for i in ids], "doc_id bigint, text string")).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows} == {(3, 0, 0)}
    assert all(r["base_score"] == 0 for r in rows)
