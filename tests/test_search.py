"""Similar cases by bounds, far and near points of large sets, the stored index."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions import geometry as G
from seamline.functions import many_points as M
from seamline.operators import block_scores as B
from seamline.operators import near_profiles as C
from seamline.operators import retrieval as R
from seamline.operators import similarity as S
from seamline.operators import stored_index as X

PROFILE = "image int, n_instances int, distribution string, extent_ratio double, mean_nn_norm double, small double, medium double, large double, elongated double, mean_d double"


def profile(rng, i):
    n = rng.choice([0, 1, 1, 2, 3, 5, 9, 40])
    if n == 0:
        return (i, 0, "해당없음", None, None, 0.0, 0.0, 0.0, 0.0, 0.0)
    a = rng.randint(0, n)
    b = rng.randint(0, n - a)
    far = n > 1
    return (i, n, "단독" if n == 1 else rng.choice(["군집", "산재", "선상"]), rng.random() if far else None, rng.random() if far and rng.random() < 0.9 else None, a / n, b / n, (n - a - b) / n, rng.randint(0, n) / n, rng.choice([0.0, rng.random() * 9]))


@pytest.mark.parametrize("k", [1, 5, 50])
def test_nearest_is_ranking_of_all_pairs(spark, k):
    rng = random.Random(k)
    rows = [profile(rng, i) for i in range(900)]
    rows += [(1000 + i, *rows[7][1:]) for i in range(200)]  # a large group of equal profiles
    cases = spark.createDataFrame(rows, PROFILE).withColumn("verdict", F.when(F.col("image") % 2 == 0, "abnormal").otherwise("normal")).repartition(3)
    queries = cases.where("image % 25 = 0").drop("verdict")
    shown = ("query_id", "case_id", "rank", "verdict")
    expected = {(*(r[c] for c in shown), round(r["score"], 9)) for r in S.ranked(S.scored(queries, cases), k).collect()}
    assert {(*(r[c] for c in shown), round(r["score"], 9)) for r in S.nearest(queries, cases, k).collect()} == expected


def test_nearest_of_few_or_no_cases(spark):
    rows = [profile(random.Random(1), i) for i in range(3)]
    cases = spark.createDataFrame(rows, PROFILE)
    assert S.nearest(cases, cases, 5).count() == 9
    assert S.nearest(cases, cases.limit(0), 5).collect() == []


def test_few_candidates_of_many_cases(spark):
    rng = random.Random(5)
    cases = spark.createDataFrame([profile(rng, i) for i in range(20_000)], PROFILE)
    met, meant = [], C.candidates

    def counted(*args):
        out = meant(*args)
        met.append(out.count())
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(C, "candidates", counted)
        top = S.nearest(cases.where("image % 100 = 0"), cases, 5)
    assert top.count() == 1000
    # 4,000,000 pairs and 200 queries; ties and cells of one profile included
    assert met[0] < 200 * 5 * 20


def sets(rng):
    yield rng.normal(size=(500, 2))
    yield np.round(rng.normal(size=(600, 2)) * 3)  # many equal points
    yield np.column_stack([np.arange(400.0), np.zeros(400)])
    yield np.tile([[3.0, 4.0]], (300, 1))
    yield np.concatenate([rng.normal(size=(300, 2)) * 1e-6, rng.normal(size=(300, 2)) * 1e3])
    t = np.linspace(0, 2 * np.pi, 700, endpoint=False)
    yield np.column_stack([np.cos(t), np.sin(t)])
    yield np.array([[0.0, 0.0], [1.0, 1.0]] * 150)


def test_far_and_near_points():
    for p in sets(np.random.default_rng(2)):
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        assert M.farthest(p) == pytest.approx(d.max(), rel=1e-12, abs=1e-300)
        np.fill_diagonal(d, np.inf)
        assert M.nearest(p) == pytest.approx(d.min(axis=1), rel=1e-9, abs=1e-300)


def test_large_polygons_in_spark(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [(float(a), float(b)) for a, b in rng.normal(size=(n, 2))]) for i, n in enumerate((0, 1, 2, 256, 257, 1000))] + [(9, None)]
    df = spark.createDataFrame(rows, "i int, p array<struct<x:double,y:double>>")
    got = {r["i"]: (r["far"], r["near"]) for r in df.select("i", G.major_diameter(F.col("p")).alias("far"), G.nearest_mean(F.col("p")).alias("near")).collect()}
    for i, p in rows[2:-1]:
        d = np.sqrt(((np.array(p)[:, None] - np.array(p)[None]) ** 2).sum(axis=2))
        far = d.max()
        np.fill_diagonal(d, np.inf)
        assert got[i] == pytest.approx((far, d.min(axis=1).mean()), rel=1e-9)
    assert got[0][0] == got[1][0] == 0.0


def test_ten_thousand_vertices():
    t = np.linspace(0, 2 * np.pi, 10_000, endpoint=False)
    circle = np.column_stack([np.cos(t), np.sin(t)])
    start = time.time()
    assert M.farthest(circle) == pytest.approx(2.0) and len(M.nearest(circle)) == 10_000
    assert time.time() - start < 5


def test_stored_index(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = ["weld", "seam", "pore", "크랙", "the", "of", "x1"]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))
    first = [(i, text(), [rng.random(), rng.random()] if i % 3 else None) for i in range(60)]
    schema = "chunk_no long, text string, embedding array<float>"
    path = f"file://{tmp_path}/index"
    X.build(path, spark.createDataFrame(first, schema), buckets=16)
    changed = [(i, text(), [rng.random(), rng.random()]) for i in (3, 4, 60, 61)]
    X.update(path, spark.createDataFrame(changed, schema), spark.createDataFrame([(10,), (11,), (999,)], "chunk_no long"))
    again = [(4, "weld weld", None), (10, "pore again", [0.5, 0.5])]
    X.update(path, spark.createDataFrame(again, schema), spark.createDataFrame([], "chunk_no long"))
    now = {r[0]: r for r in first if r[0] not in (10, 11)} | {r[0]: r for r in changed} | {r[0]: r for r in again}
    chunks = spark.createDataFrame(list(now.values()), schema)
    queries = spark.createDataFrame([(1, "pore seam", [1.0, 0.1]), (2, "크랙", None), (3, "", [0.1, 1.0])], "query_id int, text string, embedding array<float>")
    expected = {(r["query_id"], r["chunk_no"]): round(r["bm"], 9) for r in R.bm25(R.postings(chunks), chunks, queries).collect()}
    hybrid = {(r["query_id"], r["chunk_no"]): round(r["score"], 6) for r in R.hybrid(chunks, R.bm25(R.postings(chunks), chunks, queries), queries).collect()}
    X.compact(spark, path, f"{path}-compact")
    for at in (path, f"{path}-compact"):
        assert {(r["query_id"], r["chunk_no"]): round(r["bm"], 9) for r in X.bm25(spark, at, queries).collect()} == expected
        assert {(r["query_id"], r["chunk_no"]): round(r["score"], 6) for r in X.search(spark, at, queries).collect()} == hybrid
    plan = X.live(spark, path, "postings", [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_index_without_vectors(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    X.build(path, spark.createDataFrame([(1, "a pore"), (2, None)], "chunk_no long, text string"))
    queries = spark.createDataFrame([(1, "pore")], "query_id int, text string")
    assert [r["chunk_no"] for r in X.search(spark, path, queries).where("score > 0").collect()] == [1]


def test_index_is_written_in_packs(spark, tmp_path):
    """No row for each term of each chunk, and the same terms back, also of chunks that have none."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh 가나", k=rng.randint(0, 60))) for _ in range(400)] + [None, "a"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_no long, text string").repartition(2)
    path = f"file://{tmp_path}/index"
    X.build(path, chunks.where("chunk_no % 2 = 0"), buckets=8)
    X.update(path, chunks.where("chunk_no % 4 = 1"), chunks.where("chunk_no % 10 = 0"))
    X.update(path, chunks.where("chunk_no % 20 = 0"), chunks.limit(0))
    expected = {r["chunk_no"]: (r["dl"], list(r["keys"]), list(r["tf"])) for r in B.bags(chunks.where("chunk_no % 4 = 1 or chunk_no % 2 = 0 and (chunk_no % 10 > 0 or chunk_no % 20 = 0)"), "chunk_no").collect()}
    got = X.bags(spark, path, chunks.withColumnRenamed("chunk_no", "query_id")).collect()
    assert {r["chunk_no"]: (r["dl"], r["keys"], r["tf"]) for r in got} == expected and len(got) == len(expected)
    assert X.load(spark, path, "postings").count() < len(expected)
    some = X.bags(spark, path, spark.createDataFrame([(1, "ab")], "query_id int, text string")).collect()
    assert len(some) == len(expected) and 0 < sum(len(r["keys"]) for r in some) < sum(len(k) for _, k, _ in expected.values())
