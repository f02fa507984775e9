"""Operator 13 against a brute-force version that builds every window's text."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from seamline.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target):
    s, t, out = [0] * 10000, [0] * 10000, []
    for _, text in docs:
        for b in windows(text)[1]:
            s[b] += 1
    for text in target:
        for b in windows(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    for i, text in docs:
        n, found = windows(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(fit[: 5 * len(fit) // 100], 1)}
    return sorted(((r[0], *r[2:], rank.get(id(r))) for r in out), key=repr)


def corpus(rng, n):
    vocabulary = [f"wort{i}" for i in range(200)] + ["Ärger", "ÉTÉ", "x", "9", "Ab", "b" * 90, "日本"]
    gaps = [" ", "  ", "\n", "-", ", ", " ", "\t_"]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(k))
    return [(i, text(rng.randint(0, 60))) for i in range(n)], [text(rng.randint(3, 40)) for _ in range(10)]


def test_whole_query(spark, tmp_path):
    docs, target = corpus(random.Random(5), 300)
    # null and empty texts, repeated rows and ids, words that no table serves, a text of several pieces
    docs += [(1000, None), (1001, ""), docs[7], (docs[8][0], docs[9][1]), (1002, f"a {'c' * 300} d {'é' * 200} e"), (1003, "viele kurze worte " * 20_000), (1004, "ohne" * 50_000)]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5).withColumn("rank", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = R.op13_resampling(spark, str(tmp_path))
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, target)
    assert sum(r["rank"] is not None for r in got.collect()) > 5


def test_ties_and_null_ids(spark):
    docs = [(None, "gleich viele worte " * 10)] * 30 + [(7, "gleich viele worte " * 10)] * 30
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    target = spark.createDataFrame([("worte",)], "text string")
    got = sorted((tuple(r) for r in R.resampled(df, target, percent=50).collect()), key=repr)
    rows = [r for r in got if r[4] is not None]
    assert sorted(r[4] for r in rows) == list(range(1, 31))
    assert len({r[3] for r in rows}) == 1


@pytest.mark.parametrize("of", ["docs", "target"])
def test_empty_tables(spark, of):
    docs = spark.createDataFrame([(1, "ein text")] if of == "target" else [], "doc_id bigint, text string")
    target = spark.createDataFrame([] if of == "target" else [("ein text",)], "text string")
    got = R.resampled(docs, target).collect()
    assert [tuple(r)[:2] for r in got] == ([(1, 3)] if of == "target" else [])


def test_carried_registers_are_those_of_longer_texts():
    rng = random.Random(1)
    for n in (0, 1, 2, 17, 255):
        a, b = rng.randbytes(9), rng.randbytes(n)
        got = R.carried(R.np.array([zlib.crc32(a)], R.np.uint32), R.np.array([n]))[0] ^ zlib.crc32(b)
        assert got == zlib.crc32(a + b)
