import math

from pyspark.sql import functions as F

from seamline.functions import acceptance as A
from seamline.operators import evaluation as E
from seamline.operators import history as H
from seamline.operators import judgement as J


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_table_boundaries(spark):
    up = lambda x: math.nextafter(x, math.inf)
    rows = [(d, p) for b, p, q in ((1.0, 1, 2), (2.0, 2, 3), (3.0, 3, 6), (4.0, 6, 10), (6.0, 10, 15), (8.0, 15, 25)) for d, p in ((b, p), (up(b), q))]
    df = spark.createDataFrame(rows, "d double, want int").withColumn("got", A.points(F.col("d")))
    assert df.where("got <> want").count() == 0
    limits = {r.t: (r.field, r.size_limit, r.point_limit, r.length_limit, r.ignored_up_to) for r in J.limits(spark.createDataFrame([(x,) for x in (10.0, 12.0, 25.0, 26.0, 50.0, 51.0)], "t double")).collect()}
    assert limits == {10.0: ("10x10", 4.0, 6, 6.0, 0.5), 12.0: ("10x10", 5.0, 12, 6.0, 0.5), 25.0: ("10x10", 5.0, 12, 12.5, 0.5), 26.0: ("10x20", 5.2, 24, 13.0, 0.7), 50.0: ("10x20", 10.0, 24, 25.0, 0.7), 51.0: ("10x20", 10.0, 30, 24.0, 0.7)}
    assert [value(spark, A.grade(F.lit(m))) for m in (0.5, 0.51, 1.0, 2.0, 2.01)] == [1, 2, 2, 3, 4]
    assert value(spark, A.grade(F.lit(0.1), F.lit(True))) == 4


def test_margin_ignores_small_defects_and_empty_images(spark):
    df = spark.createDataFrame([(1, 20.0, 0.5), (1, 20.0, 0.4), (2, 20.0, 6.0), (2, 20.0, 1.0), (3, 20.0, None)], "image int, t double, d double")
    got = {r.image: (r.n, r.points, r.margin) for r in J.porosity_margin(df).collect()}
    assert got == {1: (0, 0, 0.0), 2: (2, 11, 1.2), 3: (0, 0, 0.0)}


def test_verdicts_hold_and_round_before_comparing(spark):
    df = spark.createDataFrame([(1, 0.9, 0.1), (2, 1.0, 0.1), (3, 1.0001, 0.1), (4, 9.0, None)], "image int, margin double, spacing double")
    got = {r.image: (r.margin, r.grade, r.verdict) for r in J.judged(df).collect()}
    assert got == {1: (0.9, 2, "합격"), 2: (1.0, 2, "합격"), 3: (1.0001, 3, "불합격"), 4: (None, None, "보류")}


def test_escalation_takes_the_first_reason(spark):
    base = {"human": 0, "rule": 0, "ai": True, "conf": 0.9, "supported": True, "scaled": True, "grade": 2, "sim": 0.9, "complete": True, "margin": 0.5}
    cases = [({}, None), ({"margin": 0.85}, "grey_zone"), ({"complete": False, "margin": 1.18}, "input_missing"), ({"sim": 0.45, "complete": False}, "few_similar"), ({"grade": 4, "sim": 0.1}, "rule_reject"), ({"scaled": False, "grade": 4}, "scale_unknown"), ({"supported": False, "scaled": False}, "unsupported"), ({"conf": 0.4, "supported": False}, "low_confidence"), ({"human": 1, "conf": 0.1}, "mismatch"), ({"sim": None}, None)]
    df = spark.createDataFrame([tuple((base | c)[k] for k in base) + (want,) for c, want in cases], "human int, rule int, ai boolean, conf double, supported boolean, scaled boolean, grade int, sim double, complete boolean, margin double, want string")
    c = F.col
    got = df.select("want", H.escalation(c("human"), c("rule"), c("ai"), c("conf"), c("supported"), c("scaled"), c("grade"), c("sim"), c("complete"), c("margin")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_sweep_counts_every_row_and_matches_brute_force(spark):
    rows = [(i, i % 2, [((i * 7) % 100) / 100, ((i * 13) % 100) / 100][: i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "stem int, label int, confs array<double>")
    for least in (1, 2):
        for r in E.sweep(df, least=least).collect():
            assert r.tp + r.fp + r.fn + r.tn == 60
            assert r.tp == sum(1 for _, y, c in rows if y == 1 and sum(x >= r.thr for x in c) >= least)
            assert r.fp == sum(1 for _, y, c in rows if y == 0 and sum(x >= r.thr for x in c) >= least)
    best = E.operating_point(E.sweep(df), 2.0).first()
    assert best.f1 == max(r.f1 for r in E.sweep(df).collect())


def test_auc_handles_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "score double, label int")
    assert E.auc(df).first().roc_auc == 0.875
    assert E.auc(df.where("label = 1")).first().roc_auc is None


def test_limits_of_all_thicknesses(spark, tmp_path):
    from seamline.plans import judging

    spark.createDataFrame([(7,), (7,), (200,)], "p_size int").write.parquet(str(tmp_path / "part.parquet"))
    assert sorted(r.t for r in judging.rule_limits(spark, str(tmp_path)).collect()) == [*map(float, range(1, 121)), 200.0]


def test_sensitivity_counts_the_grid_at_once(spark):
    rows = [(i % 40, 0.3 * (i % 29)) for i in range(400)] + [(99, 0.1), (100, None)]
    defects = spark.createDataFrame(rows, "image int, d double")
    got = J.sensitivity(defects, [20.0, 50.0], [0.5, 1.5])
    for r in got.collect():
        images = J.porosity_margin(defects.select("image", (F.col("d") * r.scale).alias("d"), F.lit(r.t).alias("t")))
        assert (r.images, r.rejected) == (images.count(), images.where("margin > 1").count())
    assert got.count() == 4 and J.sensitivity(defects.limit(0), [20.0], [1.0]).collect() == []
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # above it: defects are not multiplied
