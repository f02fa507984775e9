"""The case table: build, versions, settings, JSON form, search."""

import json

import pytest
from pyspark.sql import functions as F

from seamline.operators import case_table as T
from seamline.operators import similarity as S


def test_build_store_load(spark, tmp_path):
    box = lambda *v: {"bbox": list(v)}
    files = [(1, json.dumps([box(100, 100, 20, 20)])), (2, json.dumps([box(100, 100, 50, 50), box(900, 500, 80, 80), box(400, 300, 10, 90)])), (3, json.dumps({"label": "ok", **box(1, 1, 9, 9)})), (4, "{")]
    images = [(i, f"a{i}.jpg", f"images/a{i}.jpg", 1280, 720, "abnormal") for i in (1, 2, 3, 4, 5)] + [(9, "n.png", None, 1280, 720, "normal")]
    df = spark.createDataFrame(images, "label_id long, filename string, image_path string, width int, height int, verdict string")
    profiles, settings = T.built(df, spark.createDataFrame(files, "label_id long, text string"), spacing=0.5)
    path = f"file://{tmp_path}/cases"
    T.save(profiles, settings, path, 1)
    T.save(profiles.where("image = 9"), settings | {"spacing": None, "unit": "px"}, path, 2)
    assert T.versions(spark, path) == [1, 2]
    rows, back = T.load(spark, path, 1)
    assert back == settings and settings["unit"] == "mm" and 0 < settings["lo"] <= settings["hi"]
    got = {r["image"]: r for r in rows.collect()}
    assert {i: (r["verdict"], r["distribution"], r["n_instances"]) for i, r in got.items()} == {1: ("abnormal", "단독", 1), 2: ("abnormal", "산재", 3), 9: ("normal", "해당없음", 0)}
    assert got[2]["elongated"] == pytest.approx(1 / 3) and got[9]["extent_ratio"] is None and got[1]["meta"] == {"stem": "a1", "label_id": "1", "image_path": "images/a1.jpg"}
    latest, other = T.load(spark, path)
    assert [r["image"] for r in latest.collect()] == [9] and other["spacing"] is None
    text = rows.select("image", T.to_json().alias("j"))
    assert json.loads(text.where("image = 9").first()["j"])["extent_ratio"] is None
    again = text.select(T.from_json(F.col("j")).alias("p")).select("p.*")
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    q = rows.where("image = 1")
    ids = lambda top: [r["case_id"] for r in top.orderBy("rank").collect()]
    assert ids(S.nearest(q, rows, 2)) == ids(S.ranked(S.scored(q, rows), 2)) and ids(S.nearest(q, rows, 2))[0] == 1


def test_no_images(spark):
    empty = spark.createDataFrame([], "label_id long, filename string, image_path string, width int, height int, verdict string")
    profiles, settings = T.built(empty, spark.createDataFrame([], "label_id long, text string"))
    assert profiles.collect() == [] and settings["lo"] == settings["hi"] == 0.0
