"""Image headers, check of a split, threshold contract, registry of sources."""

import struct

import pytest
from pyspark.sql import functions as F

from seamline.operators import dataset as D
from seamline.operators import evaluation as E
from seamline.plans import verification as V
from seamline.sources import files as S
from seamline.sources import images as M


def jpeg(w, h, before=b""):
    return b"\xff\xd8" + before + b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\x00" * 9


def tiff(w, h, order="<"):
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 12) + b"\0" * 4
    short = lambda tag, v: struct.pack(order + "HHIHH", tag, 3, 1, v, 0)
    return head + struct.pack(order + "H", 3) + short(254, 0) + short(256, w) + struct.pack(order + "HHII", 257, 4, 1, h)


def test_header_sizes():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 1280, 720)
    bmp = b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 640, -480)
    old = b"BM" + b"\0" * 12 + struct.pack("<IHH", 12, 640, 480)
    # a thumbnail inside an APP1 segment is not the image; filling bytes stand before a marker
    app = b"\xff\xe1" + struct.pack(">H", 2 + len(jpeg(9, 9))) + jpeg(9, 9) + b"\xff"
    assert [M.header_size(x) for x in (png, bmp, old, jpeg(1280, 720), jpeg(5, 6, app), tiff(7, 8), tiff(7, 8, ">"))] == [(1280, 720), (640, 480), (640, 480), (1280, 720), (5, 6), (7, 8), (7, 8)]
    large = jpeg(5, 6, (b"\xff\xe2\xff\xff" + b"\xff\xc0" * 32766 + b"\0") * 40)
    assert M.header_size(large) == (5, 6)
    for whole in (png, bmp, jpeg(5, 6), tiff(7, 8)):
        assert all(M.header_size(whole[:k]) in (None, M.header_size(whole)) for k in range(len(whole)))
    assert [M.header_size(x) for x in (None, b"", b"text", b"\xff\xd8\xff\xd9", jpeg(0, 6), b"\xff\xd8\xff\xe0\0\0")] == [None] * 6


def test_images_below_a_folder(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name, data in {"b.jpg": jpeg(3, 4), "deep/a.png": b"no image", "deep/er/c.tif": tiff(7, 8), "deep/d.txt": b"x", "deep/e.gif": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    images = M.read_images(spark, str(tmp_path))
    got = [(r["path"].rsplit("/", 1)[1], r["width"], r["height"]) for r in M.with_size(images).orderBy("path").collect()]
    assert got == [("b.jpg", 3, 4), ("a.png", None, None), ("c.tif", 7, 8)]
    clash = images.select("path", "content", F.lit("x").alias("width"))
    assert M.with_size(clash).columns == ["path", "width", "height"]


def test_faults_of_label_texts(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(V.FORMS)], "i int, text string")
    got = {r["i"]: (r["f"]["bad_lines"], r["f"]["bad_coords"]) for r in rows.select("i", D.text_faults(F.col("text")).alias("f")).collect()}
    assert got == {i: (bad, out) for i, (_, bad, out) in enumerate(V.FORMS)}


def test_report_of_odd_splits(spark):
    images = spark.createDataFrame([("train", "a", 1280, 720), ("train", "a", 1280, 721), ("train", "b", None, None), ("val", "c", 1280, 720)], "split string, stem string, width int, height int")
    labels = spark.createDataFrame([("train", "a", None), ("train", "z", "0 1 2"), ("other", "c", "")], "split string, stem string, text string")
    got = {r["split"]: tuple(r)[1:] for r in D.split_report(images, labels).collect()}
    assert got == {"train": (2, 2, 1, 1, 1, 1, 0, 2, 2), "val": (1, 0, 1, 0, 0, 0, 0, 0, 1), "other": (0, 1, 0, 1, 1, 0, 0, 0, 0)}
    assert D.split_report(images.limit(0), labels.limit(0)).count() == 0


def test_contract_round_trip_and_refusals(spark, tmp_path):
    held = spark.createDataFrame([(1, [0.9]), (1, [0.2]), (0, [0.5]), (0, [])], "label int, confs array<double>")
    row = E.contract(spark.createDataFrame([(0.4,)], "thr double"), held)
    S.write_contract(row, str(tmp_path / "t"))
    got = S.read_contract(spark, str(tmp_path / "t")).first()
    assert (got["decision_conf"], got["infer"]["max_det"], got["metrics_on_heldout"]["tp"], got["metrics_on_heldout"]["fp"]) == (0.4, 300, 1, 1)
    with pytest.raises(ValueError):
        S.read_contract(spark, str(tmp_path / "t"), "2.0")
    S.write_contract(row.limit(0), str(tmp_path / "e"))
    with pytest.raises(ValueError):
        S.read_contract(spark, str(tmp_path / "e"))


def test_registry_of_sources(spark, tmp_path):
    (tmp_path / "s.yaml").write_text('# note\nsources:\n  - doc_id: A\n    edition: 2026\n    effective_date: 2026-07-01\n    chapters: ["2", 부록]\n    skip: true\n  - doc_id: B\n    doc_types: rule\n    other: {x: 1}\n', encoding="utf-8")
    got = S.read_sources(spark, str(tmp_path / "s.yaml")).orderBy("no").collect()
    assert [(r["doc_id"], r["edition"], r["effective_date"], r["chapters"], r["doc_types"], r["skip"]) for r in got] == [("A", "2026", "2026-07-01", ["2", "부록"], None, True), ("B", None, None, None, ["rule"], False)]
    (tmp_path / "d.yaml").write_text("sources: [{doc_id: A}, {doc_id: A}]")
    with pytest.raises(ValueError):
        S.read_sources(spark, str(tmp_path / "d.yaml"))
    (tmp_path / "n.yaml").write_text("")
    assert S.read_sources(spark, str(tmp_path / "n.yaml")).count() == 0


def test_places_of_labels(spark):
    listed = spark.createDataFrame([(1, "l/1.json", 5, 6)], "label_id long, label_path string, width int, height int")
    found = spark.createDataFrame([(1, 1), (1, 2), (9, 3), (None, 4)], "label_id long, rank int")
    assert sorted((r["rank"], r["label_path"], r["width"]) for r in D.label_places(found, listed).collect()) == [(1, "l/1.json", 5), (2, "l/1.json", 5), (3, None, None), (4, None, None)]
