import pytest
from pyspark.sql import functions as F

from seamline.functions import signals
from seamline.operators import instances as I
from seamline.operators import regulation as R


def test_instances_without_mask_take_the_box_and_settings_are_guarded(spark):
    schema = "image int, no int, conf double, box array<double>, polygon array<struct<x:double,y:double>>, w int, h int, spacing double"
    raw = spark.createDataFrame([(1, 0, 0.2, [0.0, 0.0, 9.0, 9.0], None, 100, 50, None), (1, 1, 0.9, [2.0, 2.0, 6.0, 4.0], None, 100, 50, 0.5), (1, 2, 0.3, [0.0, 0.0, 4.0, 4.0], [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)], 100, 50, None)], schema)
    got = [(r.id, r.origin, r.area_px, r.diameter_mm is None, r.cx) for r in I.instance_table(raw).orderBy("id").collect()]
    assert got == [(0, "box", 8.0, False, 4.0), (1, "mask", 8.0, True, 1.33)]
    images = spark.createDataFrame([(1, 100, 50), (2, 100, 50)], "image int, w int, h int")
    assert {(r.image, r.verdict, r.score, r.n_instances, r.total_area) for r in I.image_verdicts(raw, images).collect()} == {(1, "abnormal", 0.9, 2, 16.0), (2, "normal", 0.0, 0, 0.0)}
    for bad in ({"min_instances": 0}, {"conf": 0.5, "decision_conf": 0.4}):
        with pytest.raises(ValueError):
            I.image_verdicts(raw, images, **bad)


def test_half_width_of_a_dip(spark):
    rows = spark.createDataFrame([([10.0, 10.0, 0.0, 2.0, 10.0],), ([5.0, 5.0],), ([1.0],)], "v array<double>")
    assert [r.w for r in rows.select(signals.half_width(F.col("v"), F.lit(8.0)).alias("w")).collect()] == [6.0, 8.0, None]


def test_probe_and_editions(spark):
    rows = spark.createDataFrame([("head\nab c", "xxabcxx"), ("head\nab d", "xxabcxx"), ("ab c", "a b\tc")], "chunk string, page string")
    assert [r.f for r in rows.select(R.on_page(F.col("chunk"), F.col("page")).alias("f")).collect()] == [True, False, True]
    side = lambda *v: spark.createDataFrame([(x,) for x in v], "chunk_id string")
    assert {tuple(r) for r in R.edition_changes(side("a", "b"), side("b", "c")).collect()} == {("a", "removed"), ("c", "added")}
