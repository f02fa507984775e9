"""Operator 11 against scores of all documents, computed one by one."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seamline.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    found = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        rows = []
        for doc, c in found:
            m = 25 + 75 * sum(c.values()) * n_docs // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            rows += [(-score, doc is None, doc or 0, doc)] * (score > 0)
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


def corpus(rng, n, groups=6):
    """Documents on a few subjects, with words that all share."""
    common = ["der", "und", "Of", "it's", "日本"]
    subject = [[f"w{g}x{i}" for i in range(60)] for g in range(groups)]

    def text(k):
        g = rng.choice(subject)
        return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(g if rng.random() < 0.9 else rng.choice(subject)) for _ in range(k))

    return [(i, text(rng.randint(0, 40))) for i in range(n)], [(i, text(rng.randint(1, 15))) for i in range(25)]


@pytest.mark.parametrize("shard, block", [(64, 4), (8192, 64)])
def test_all_documents(spark, shard, block):
    docs, items = corpus(random.Random(shard), 700)
    # null and empty texts, copies with ties, equal and null ids; an item without terms, repeated items, unknown terms
    docs += [(1000, None), (1001, ""), *[(2000 + i, "gruppe gleich der texte") for i in range(300)], (5, "gruppe gleich"), (5, "gruppe gleich"), (None, "gruppe gleich der texte"), (3000, "sehr lang und " * 30_000)]
    items += [(100, "gruppe gleich gleich"), (101, " -- "), (102, None), (103, "niegesehen"), (100, "gruppe gleich gleich"), (104, "lang")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"rank": F.lit(1), "item_id": F.lit("x"), "score": F.lit(0)}).repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("y"))
    got = R.ranked_search(df, asked, shard=shard, block=block)
    expected = brute(docs, items)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected
    in_groups = R.ranked_search(df, asked, shard=shard, block=block, together=30)
    assert sorted((tuple(r) for r in in_groups.collect()), key=repr) == expected


def test_wide_items(spark):
    docs, items = corpus(random.Random(3), 200)
    items.append((99, " ".join(t for _, t in docs[:60])))
    got = R.ranked_search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), wide=100)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)


def test_blocks_are_skipped(spark):
    docs, items = corpus(random.Random(9), 4000, groups=40)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    group = R.Items.of(items)
    found = R.vectors(df, group.vocabulary)
    plan = R.Plan.of(group, *R.frequencies(found, len(group.vocabulary)))
    counts = R.search(R.index(found, plan, block=16), plan, counted=True).collect()
    seen, scored = (sum(r[c] for r in counts) for c in ("blocks", "scored"))
    assert 0 < scored < 0.5 * seen


def test_summaries_bound_their_blocks():
    rng = R.np.random.default_rng(1)
    group = R.Items.of([(0, "a b c d e f g h"), (1, "b d f h")])
    df = R.np.array([5, 50, 20, 90, 10, 70, 30, 80])
    plan = R.Plan.of(group, 100, 800, df)
    rows = [R.np.sort(rng.choice(8, rng.integers(0, 8), replace=False)) for _ in range(100)]
    ends, terms_ = R.np.cumsum([len(r) for r in rows]), R.np.concatenate(rows)
    x = {k: v for k, (v, _) in R.shard_rows(plan, R.np.arange(100), R.np.full(100, 8), ends, terms_, rng.integers(1, 4, len(terms_)), 8).items()}
    starts, first = R.np.append(0, x["ends"]), R.np.append(0, x["list_blocks"])
    for j, t in enumerate(x["list_terms"]):
        for b in range(first[j], first[j + 1]):
            lo = x["block_ends"][b - 1] if b else 0
            most = {}
            for doc in x["members"][lo : x["block_ends"][b]]:
                for u, v in zip(x["terms"][starts[doc] : starts[doc + 1]], x["vals"][starts[doc] : starts[doc + 1]]):
                    if u in plan.beside[t]:
                        most[int(u)] = max(most.get(int(u), 0), int(v))
            a = x["sum_ends"][b - 1] if b else 0
            assert most == dict(zip(x["sum_terms"][a : x["sum_ends"][b]].tolist(), x["sum_vals"][a : x["sum_ends"][b]].tolist()))
    assert sorted(x["members"][: x["block_ends"][first[1] - 1]]) == [i for i, r in enumerate(rows) if plan.rank.tolist().index(int(x["list_terms"][0])) in r]


@pytest.mark.parametrize("of", ["docs", "items"])
def test_empty_tables(spark, of):
    docs = spark.createDataFrame([(1, "ein text")] if of == "items" else [], "doc_id bigint, text string")
    items = spark.createDataFrame([] if of == "items" else [(1, "ein text")], "item_id bigint, text string")
    assert R.ranked_search(docs, items).collect() == []
