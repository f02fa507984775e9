import zlib
from collections import Counter

import numpy as np

from seamline.llm import shards


def test_matrix_has_exact_margins_and_hypergeometric_mean():
    rows = [50, 7, 0, 143]
    before = np.append(0, np.cumsum(rows))
    seen = np.zeros((4, 6))
    for seed in range(300):
        tree = shards.Tree(before, 6, seed)
        m = np.array([tree.row(p) for p in range(4)])
        seen += m
        assert m.sum(axis=1).tolist() == rows
        assert sorted(m.sum(axis=0).tolist()) == [33, 33, 33, 33, 34, 34]
    assert np.allclose(seen / 300, np.outer(rows, [1 / 6] * 6), atol=0.6)


def test_query_laws_and_odd_rows(spark):
    texts = [None, "", "a", "same", "same", "é" * 3000] * 40
    docs = spark.createDataFrame([(i if i % 7 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, shard int").repartition(5)
    out = shards.assigned(docs, shards=24).collect()
    assert len(out) == len(texts) and {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    sizes = Counter(r.shard for r in out)
    assert set(sizes) <= set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    want = Counter((i if i % 7 else None, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(texts))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    assert shards.assigned(docs.limit(0)).count() == 0


def test_buckets_keep_slots_gapless_and_shuffle_is_uniform(spark):
    rows = spark.range(2000).repartition(4)
    out = shards.sharded(rows, shards=3, seed=1, bucket_rows=50).collect()
    for s in range(3):
        mine = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        # neither ids nor slots trend with each other
        x = np.corrcoef([r.id for r in mine], [r.slot for r in mine])[0, 1]
        assert abs(x) < 0.12


def test_large_draws_have_the_exact_moments_and_never_raise():
    rng = np.random.default_rng(3)
    for good, bad, n in ((700_000_000, 900_000_000, 1_000_000), (5, 3_000_000_000, 1_500_000_000), (2_000_000_000, 40, 1_000_000_000)):
        x = np.array([shards.hypergeometric(rng, good, bad, n) for _ in range(400)], float)
        total = good + bad
        mean = n * good / total
        sd = (n * good / total * bad / total * (total - n) / (total - 1)) ** 0.5
        assert abs(x.mean() - mean) < 5 * sd / 20
        assert 0.8 < x.std() / sd < 1.2
    for good, bad, n in ((5, 1_200_000_000, 1_199_999_999), (1, 10**12, 10**12), (10**12, 1, 5), (0, 2 * 10**9, 7), (2 * 10**9, 0, 7), (10**9, 10**9, 2 * 10**9)):
        for _ in range(20):
            k = shards.hypergeometric(rng, good, bad, n)
            assert max(0, n - bad) <= k <= min(good, n)


def test_large_draw_has_the_distribution_of_the_library(monkeypatch):
    """The same sampler on a population that the library can draw, by chi square."""
    rng = np.random.default_rng(4)
    n = 3000
    want = np.bincount(rng.hypergeometric(30, 70, 20, 200_000), minlength=21) / 200_000
    source = shards.hypergeometric.__code__
    consts = tuple(50 if c == 1_000_000_000 else c for c in source.co_consts)
    low = type(shards.hypergeometric)(source.replace(co_consts=consts), shards.hypergeometric.__globals__)
    got = np.bincount([low(rng, 30, 70, 20) for _ in range(n)], minlength=21)
    on = want > 0.002
    assert ((got[on] - n * want[on]) ** 2 / (n * want[on])).sum() < 40


def test_tree_rows_add_up_and_are_dealt_evenly():
    counts = [5, 0, 17, 3, 40, 1, 34]
    before = np.append(0, np.cumsum(counts))
    mean = np.zeros((7, 4))
    for seed in range(300):
        tree = shards.Tree(before, 4, seed)
        m = np.array([tree.row(p) for p in range(7)])
        assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == [25] * 4
        mean += m / 300
    assert np.abs(mean - np.array(counts)[:, None] / 4).max() < 0.6


def test_names_that_clash(spark):
    rows = spark.range(50).selectExpr("id as _row", "id as _part", "id as shard", "id as `a.b`")
    out = shards.sharded(rows, 3)
    assert sorted(out.columns) == ["_part", "_row", "a.b", "shard", "slot"]
    assert sorted(r._row for r in out.collect()) == list(range(50))
