"""Readers that report what they could not read; documents in parts."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seamline.operators import history as H
from seamline.operators import payload as P
from seamline.sources import files as S


def label(cls="기공", **more):
    return {"info": {"id": 1, "type": "RT"}, "image_data": {"file_name": "a", "format": "jpg", "width": 1280, "height": 720, "information": cls}, "meta": {"is_crowd": 0, "annotation_case": ["porosity"]}, "annotations": [], **more}


def test_label_folder_with_faults(spark, tmp_path):
    folder = tmp_path / "labels" / "deep"
    folder.mkdir(parents=True)
    texts = {"a": json.dumps(label()), "b": "{broken", "c": "", "d": json.dumps({"info": {}}), "e": json.dumps(label(image_data={"file_name": "e.1", "format": "png"}, annotations=None)), "f": "[1]"}
    for name, text in texts.items():
        (folder / f"{name}.json").write_text(text, encoding="utf-8")
    (folder / "h.json").write_bytes(b'{"info": "\xff"}')
    (folder / "g.txt").write_text("no label")
    rows, errors = S.catalogued(S.read_label_files(spark, str(tmp_path / "labels")), spark.createDataFrame([("a.jpg",), ("a.jpg",)], "file_name string"), "val")
    got = {r["label_path"]: (r["filename"], r["class"], r["num_annotations"], r["image_exists"]) for r in rows.collect()}
    assert got == {"labels/val/a.json": ("a.jpg", "기공", 0, True), "labels/val/e.json": ("e.1.png", None, 0, False)}
    bad = {r["label_path"][11:12]: r["reason"] for r in errors.collect()}
    assert bad.pop("e") == "no image e.1.png" and set(bad) == {"b", "d", "f", "h"} and bad["b"] == bad["h"] == "no JSON"


def test_catalogue_round_trip_with_byte_order_mark(spark, tmp_path):
    rows = S.catalogue_rows(S.parsed_labels(spark.createDataFrame([("x/a.json", json.dumps(label()))], "path string, text string"))[0], spark.createDataFrame([("a.jpg",)], "file_name string"), "train")
    S.write_catalogue(rows, str(tmp_path / "c"))
    part = next((tmp_path / "c").glob("part-*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbflabel_id,")
    back = S.read_catalogue(spark, str(tmp_path / "c")).first()
    assert (back["label_id"], back["image_exists"], back["is_tile"], back["croppable"], round(back["aspect"], 3)) == (1, True, True, True, 1.778)


@pytest.mark.parametrize("text, fault", [("label_id,filename\n1,a\n", "missing"), (" label_id,filename,width,height,is_crowd,annotation_case,split,image_exists\n" + "1,a,1,1,0,x,train,True\n" * 2, "not unique")])
def test_catalogue_faults(spark, tmp_path, text, fault):
    (tmp_path / "c.csv").write_text(text, encoding="utf-8-sig")
    with pytest.raises(ValueError, match=fault):
        S.read_catalogue(spark, str(tmp_path / "c.csv"))


def test_payload_is_one_document(spark, tmp_path):
    def square(side, **more):
        return {"class": "defect", "coordinate": {"x": [0, side, side, None], "y": [0, 0, side * 4 / 3]}} | more

    notes = [square(1.5), square(1.5, **{"class": "normal"}), square(2.1), {"class": "defect", "coordinate": {"x": [1], "y": [1]}}, {"class": None, "coordinate": None}, {"coordinate": {"x": [0, 3], "y": [0, 4]}}]
    docs = [("b", label("균열", annotations=notes, info={"id": 1, "type": "vt-3"})), ("a", label("unknown", info={"id": 2})), ("c", label(None, annotations=None))]
    labels, _ = S.parsed_labels(spark.createDataFrame([(k, json.dumps(d)) for k, d in docs], "path string, text string"))
    P.write_document(P.payload(labels.repartition(3), "s"), str(tmp_path / "p"))
    whole = json.loads("".join(p.read_text(encoding="utf-8") for p in sorted(Path(tmp_path / "p").glob("part-*"))))
    # 2.5 goes to the even 2, 3.5 to 4
    assert whole["rows"] == [[0, 0], [1, 4, 2, 4, 5], [0, 0]] and (whole["n_images_total"], whole["n_defects_total"]) == (3, 3)


def test_empty_and_several_lists(spark):
    none = spark.createDataFrame([], "k long, json string")
    many = spark.range(500).select("id", F.to_json(F.struct("id")).alias("json"))
    join = lambda lines: json.loads("".join(r["value"] for r in sorted(lines.collect())))
    assert join(P.document({}, {"x": none})) == {"x": []}
    assert join(P.document({"é": 1}, {"x": none, "y": many, "z": many.limit(1)})) == {"é": 1, "x": [], "y": [{"id": k} for k in range(500)], "z": [{"id": 0}]}


def test_sample_and_manager_filters(spark):
    files = spark.range(4000).select(F.concat(F.lit("p"), "id").alias("path"))
    some = {r["path"] for r in P.sampled(files, 0.25).collect()}
    assert 850 < len(some) < 1150 and some == {r["path"] for r in P.sampled(files.repartition(7), 0.25).collect()} and P.sampled(files, 1.0).count() == 4000
    h = spark.createDataFrame([(1, "a", 3), (2, "b", 3), (3, "a", None)], "day int, part string, level int")
    days = lambda **f: sorted(r["day"] for r in H.managed(h, **f).collect())
    assert days() == [1, 2, 3] and days(days=(2, 3)) == [2, 3] and days(part="a", level=3) == [1] and days(part=["a", "b"], level=None) == [1, 2, 3]


def test_label_texts_are_parsed_once(spark):
    files = spark.createDataFrame([("x/a.json", json.dumps(label())), ("x/b.json", "{")], "path string, text string").repartition(2)
    for df in S.catalogued(files, spark.createDataFrame([("b.jpg",)], "file_name string"), "val"):
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.count("from_json(") == 1, plan
