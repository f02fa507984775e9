import math
import random

import numpy as np
from pyspark.sql import functions as F

from seamline.functions import geometry as G
from seamline.operators import profiles as P
from seamline.operators import similarity as S

SCHEMA = "i int, p array<struct<x:double,y:double>>"


def test_measures_match_numpy(spark):
    rng = random.Random(1)
    rows = [(i, [(rng.random() * 100, rng.random() * 50) for _ in range(n)]) for i, n in enumerate((3, 4, 7, 30))] + [(9, [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0), (0.0, 5.0)])]
    p = F.col("p")
    got = {r.i: r for r in spark.createDataFrame(rows, SCHEMA).select("i", G.area(p).alias("a"), G.major_diameter(p).alias("m"), G.centroid(p).alias("c"), G.elongation(p).alias("e"), G.nearest_mean(p).alias("n")).collect()}
    for i, pts in rows:
        a = np.array(pts)
        d = np.sqrt(((a[:, None] - a[None]) ** 2).sum(-1))
        values = np.clip(np.linalg.eigvalsh(np.cov(a.T)), 1e-9, None)
        x, y = a.T
        assert math.isclose(got[i].a, abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2, rel_tol=1e-9)
        assert math.isclose(got[i].m, d.max(), rel_tol=1e-12)
        assert math.isclose(got[i].e, math.sqrt(values[1] / values[0]), rel_tol=1e-9)
        assert math.isclose(got[i].c.x, x.mean(), rel_tol=1e-12)
        np.fill_diagonal(d, np.inf)
        assert math.isclose(got[i].n, d.min(axis=1).mean(), rel_tol=1e-12)


def test_rounding_next_to_ties(spark):
    values = spark.createDataFrame([(0.058499999999999996,), (9.929499999999999,), (0.0,), (7.0004,), (7.0005,)], "v double")
    assert [r.v for r in values.select(G.rounded(F.col("v"), 3).alias("v")).collect()] == [0.059, 9.93, 0.0, 7.0, 7.001]


def test_normalised_polygons(spark):
    square = [(0.0, 0.0), (0.0, 0.0), (640.0, 0.0), (640.0, 360.0), (2000.0, 360.0), (0.0, 360.0), (0.0, 0.0)]
    rows = [(0, square), (1, [(0.1, 0.1), (0.4, 0.1), (0.4, 0.4)]), (2, [(1.0, 1.0), (2.0, 2.0)]), (3, [(5.0, 5.0), (6.0, 6.0), (7.0, 7.0)]), (4, [])]
    got = {r.i: r.n for r in spark.createDataFrame(rows, SCHEMA).select("i", G.normalised(F.col("p"), F.lit(1280.0), F.lit(720.0)).alias("n")).collect()}
    assert [tuple(x) for x in got[0]] == [(0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (1.0, 0.5), (0.0, 0.5)]
    assert [tuple(x) for x in got[1]] == [(0.1, 0.1), (0.4, 0.1), (0.4, 0.4)]
    assert got[2] is None and got[3] is None and got[4] is None


def test_distribution_classes(spark):
    line = [(100.0 * i, 50.0 * i) for i in range(8)]
    rows = [(0, []), (1, [(5.0, 5.0)]), (2, [(5.0, 5.0), (6.0, 6.0)]), (3, line), (4, line[:7]), (5, [(1.0, 1.0), (1000.0, 600.0)]), (6, [(3.0, 3.0)] * 3)]
    got = {r.i: r.s for r in spark.createDataFrame(rows, SCHEMA).select("i", P.distribution(F.col("p"), F.lit(1280.0), F.lit(720.0)).alias("s")).collect()}
    assert [got[i].distribution for i in range(7)] == ["해당없음", "단독", "군집", "선상", "산재", "산재", "군집"]
    assert got[3].linear_ratio == 1.0 and got[4].linear_ratio is None and got[0].extent_ratio is None and got[6].mean_nn_norm == 0.0


def test_scores_and_diverse_choice(spark):
    normal = (0, "해당없음", None, None, 0.0, 0.0, 0.0, 0.0, 0.0)
    some = lambda i: (3, "산재", 0.1 * i, 0.2, 1.0, 0.0, 0.0, 0.5, 1.0)
    schema = "image int, n_instances int, distribution string, extent_ratio double, mean_nn_norm double, small double, medium double, large double, elongated double, mean_d double"
    cases = spark.createDataFrame([(0, *normal), *((i, *some(i)) for i in range(1, 8))], schema)
    pairs = S.scored(cases, cases)
    s = {(r.query_id, r.case_id): r.score for r in pairs.collect()}
    assert math.isclose(s[0, 0], 0.97) and all(math.isclose(s[a, b], s[b, a]) and 0 <= s[a, b] <= 1 for a, b in s)
    assert all(math.isclose(s[i, i], 1.0) for i in range(1, 8))
    top = {r.rank: r.case_id for r in S.ranked(pairs.where("query_id = 1"), 3).collect()}
    assert top == {1: 1, 2: 2, 3: 3}
    chosen = [r.case_id for r in S.diverse(S.ranked(pairs.where("query_id = 1"), 50), k=3).orderBy("rank").collect()]
    # by hand: the best first, then the largest half score less half similarity to the chosen
    pool, want = sorted((c for q, c in s if q == 1), key=lambda c: -s[1, c]), []
    while len(want) < 3:
        want.append(max((c for c in pool if c not in want), key=lambda c: round(0.5 * s[1, c] - 0.5 * max((s[c, w] for w in want), default=0), 9)))
    assert sorted(chosen) == sorted(want)


def test_measures_at_once_are_the_expressions(spark):
    rng = random.Random(3)
    rows = [(i, [(float(rng.randint(0, 30)), float(rng.randint(0, 9))) for _ in range(n)]) for i, n in enumerate((0, 1, 2, 2, 5, 7, 8, 9, 40, 256, 257))] + [(20, [(1.0, None), (2.0, 3.0), (4.0, 1.0)])]
    df, (p, w) = P.measured(spark.createDataFrame(rows, SCHEMA), "p"), (F.col("p"), F.lit(100.0))
    got = df.select("i", F.col("_m").isNotNull().alias("few"), P.distribution(p, w, w, F.col("_m")).alias("a"), P.distribution(p, w, w).alias("b")).collect()
    assert [r.i for r in got if r.few] == list(range(2, 10)) and all(r.a == r.b for r in got)
