"""Training sets: crop origins as Python's generator draws them, splits, counters."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from seamline.operators import dataset as D


def test_crop_origins_are_those_of_the_library(spark):
    rows = spark.range(5000).select(F.col("id").alias("label_id"), (F.col("id") % 4000 + 1280).cast("int").alias("width"), (F.col("id") * 7 % 3000 + 720).cast("int").alias("height"), F.lit(2).alias("crops"), F.lit("z").alias("x0y0"))
    got = D.crop_origins(rows).collect()
    assert len(got) == 10_000
    for r in got:
        draw = random.Random(int(hashlib.md5(f"42:{r['label_id']}:{r['k']}".encode()).hexdigest()[:16], 16))
        assert (r["x0"], r["y0"]) == (draw.randint(0, r["width"] - 1280), draw.randint(0, r["height"] - 720))


def test_crops_need_room(spark):
    rows = spark.createDataFrame([(1, 1279, 720, 1), (2, 1280, 720, 0), (3, 1280, 720, 1), (4, None, 720, 1)], "label_id long, width int, height int, crops int")
    assert [tuple(r) for r in D.crop_origins(rows).collect()] == [(3, 1280, 720, 1, 0, 0, 0)]


def images(spark, rows):
    return D.with_shape(spark.createDataFrame(rows, "label_id long, filename string, width int, height int, is_crowd int, annotation_case string, split string, image_exists boolean"))


def test_split(spark):
    good, none = json.dumps({"bbox": [10, 10, 500, 500]}), json.dumps({"bbox": [10, 10, 500, 500], "label": "ok"})
    rows = [(i, f"a.b{i}.jpg", 1280, 720, 0, "porosity", "train", True) for i in range(6)]
    rows += [(10 + i, f"n{i}.png", 1280, 720, 0, "normal", "train", True) for i in range(2)]
    rows += [(20 + i, f"p{i}.png", 4000, 900, 0, "normal", "train", True) for i in range(4)]
    # not of the set: another size, split or case, no image, too small for a crop
    rows += [(30, "x", 900, 720, 0, "porosity", "train", True), (31, "x", 1280, 720, 0, "porosity", "val", True), (32, "x", 1280, 720, 0, "crack", "train", True), (33, "x", 1280, 720, 0, "porosity", "train", False), (34, "x", 1000, 900, 0, "normal", "train", True)]
    files = spark.createDataFrame([(0, good), (1, good), (2, none), (3, "{"), (4, good), (31, good)], "label_id long, text string")
    built, seen = D.build_split(images(spark, rows), files, "train", ratio=1.25)
    got = {(r["label_id"], r["stem"]): r for r in built.collect()}
    # 1.25 * 6 = 7.5 negatives, rounded to even: 8, of which 2 tiles and 6 crops of 3 panoramas
    assert seen.get == {"pos_ok": 3, "pos_no_poly": 2, "pos_missing": 1, "neg_tile": 2, "neg_crop": 6, "total_polygons": 3, "n_images": 11}
    assert got[0, "a.b0"]["label_text"] == "0 0.007812 0.013889 0.398438 0.013889 0.398438 0.708333 0.007812 0.708333\n" or got[0, "a.b0"]["label_text"].startswith("0 0.0078")
    assert {r["status"] for r in got.values() if r["label_id"] < 6} == {"pos_ok", "pos_no_poly", "pos_missing"}
    crops = [r for r in got.values() if r["status"] == "neg_crop"]
    assert len(crops) == 6 and all(r["stem"].startswith("p") and "_crop" in r["stem"] and r["label_text"] == "" for r in crops)
    manifest, counted = D.build_all(images(spark, rows), files, ratio=1.25)
    assert manifest.count() == 12 and "status" not in manifest.columns
    assert {r["split"]: r["n_images"] for r in counted.collect()} == {"train": 11, "val": 1}


def test_caps_and_nothing(spark):
    rows = [(i, "f.jpg", 1280, 720, 0, "porosity" if i % 2 else "normal", "train", True) for i in range(20)]
    files = spark.createDataFrame([(i, json.dumps({"bbox": [1, 1, 99, 99]})) for i in range(20)], "label_id long, text string")
    got = D.build_split(images(spark, rows), files, "train", most=4)[0].groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"pos_ok": 4, "neg_tile": 4}
    assert D.build_split(images(spark, rows), files, "val")[0].collect() == []


def test_case_rows(spark):
    rows = [(1, "f", 900, 720, 0, "porosity", "train", True), (2, "f", 1280, 720, 1, "porosity", "train", True), (3, "f", 1280, 720, 1, "normal", "val", True), (4, "f", 900, 720, 0, "normal", "val", True), (5, "f", 1280, 720, 0, "normal", "val", False)]
    assert {(r["label_id"], r["verdict"]) for r in D.case_rows(images(spark, rows)).collect()} == {(1, "abnormal"), (3, "normal")}
