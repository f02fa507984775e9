"""Numbers, running sums and quantiles against plain Python and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.operators import order as O


def test_numbered_and_running(spark):
    rng = random.Random(3)
    values = [(i, rng.choice([None, 1.0, 1.0, 1.0, 2.0, rng.random()]), rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(values, "id int, v double, n bigint").repartition(7)
    expected = sorted(values, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    got = {r["id"]: r["place"] for r in O.numbered(df, F.desc_nulls_first("v"), F.asc("id")).collect()}
    assert [got[r[0]] for r in expected] == list(range(1, 3001))
    sums = {r["id"]: (r["upto"], r["cnt"]) for r in O.running(df.withColumn("one", F.lit(1)), F.desc_nulls_first("v"), F.asc("id"), upto="n", cnt="one").collect()}
    assert [sums[r[0]] for r in expected] == [(int(s), k) for k, s in enumerate(np.cumsum([r[2] for r in expected]), 1)]
    assert {r["id"] for r in O.chosen(df, 10, F.desc_nulls_first("v"), F.asc("id")).collect()} == {r[0] for r in expected[:10]}


def test_nothing_to_number(spark):
    empty = spark.createDataFrame([], "id int, n bigint")
    assert O.numbered(empty, F.asc("id")).collect() == [] and O.running(empty, F.asc("id"), s="n").collect() == []


def test_no_single_partition(spark):
    plan = O.running(spark.range(1000).withColumn("n", F.lit(1)), F.asc("id"), s="n")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("make", [
    lambda r: [r.random() for _ in range(2001)], lambda r: [1.0] * 50, lambda r: [r.choice([0.0, 1.0, 5e-324, 1e308, -1e308]) for _ in range(500)],
    lambda r: [10.0 ** r.randint(-200, 200) for _ in range(700)], lambda r: [3.5], lambda r: [float(r.randrange(10)) for _ in range(999)] + [math.nan, None],
])
def test_quantiles(spark, make):
    values = make(random.Random(1))
    shares = [0.0, 0.25, 0.33, 0.5, 0.67, 0.75, 1.0]
    got = O.quantiles(spark.createDataFrame([(v,) for v in values], "v double").repartition(3), "v", shares)
    clean = sorted(v for v in values if v is not None and not math.isnan(v))
    for share, x in zip(shares, got):
        p = share * (len(clean) - 1)
        a, b = clean[int(p)], clean[min(int(p) + 1, len(clean) - 1)]
        assert x == pytest.approx(a if a == b else (1 - (p - int(p))) * a + (p - int(p)) * b, rel=1e-12)


def test_no_quantiles(spark):
    assert O.quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]
