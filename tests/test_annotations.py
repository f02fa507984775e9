"""Polygons anywhere in label JSON: every layout, label order, outcomes, nesting."""

import json
import math

import pytest
from pyspark.sql import functions as F

from seamline.operators import annotations as A

SQUARE = [[10, 20], [30, 20], [30, 60], [10, 60]]


def ring(cx, cy, r):
    return [[cx + r * math.cos(2 * math.pi * i / 24), cy + r * math.sin(2 * math.pi * i / 24)] for i in range(24)]


#: JSON, and per node found (path, label, points in pixels or an outcome).
CASES = [
    ({"points": SQUARE}, [("$", None, SQUARE)]),
    ({"shapes": [{"Label": "Porosity", "POINTS": SQUARE}]}, [("$.shapes[0]", "porosity", SQUARE)]),
    ({"coordinate": {"X": [10, 30, 30], "y": [20, 20, 60]}}, [("$", None, SQUARE[:3])]),
    ({"coordinate": {"x": [10, 30, 30], "y": [20, 20]}}, [("$", None, "skipped_geom")]),
    ({"segmentation": [[10, 20, 30, 20, 30, 60], [1, 2, 3, 4, 5, 6]]}, [("$", None, SQUARE[:3])]),
    ({"coords": [10, "20", 30, 20, 30, 60.0]}, [("$", None, SQUARE[:3])]),
    ({"coords": [10, 20, 30, 20, 30]}, [("$", None, "skipped_geom")]),
    ({"coords": [10, 20, 30, 20, 30, "x"]}, [("$", None, "skipped_geom")]),
    ({"coords": [10, 20, 30, 20, 30, None]}, [("$", None, "skipped_geom")]),
    ({"poly": [{"x": 10, "y": 20}, {"cx": 30, "row": 20}, {"col": 30, "Y": 60}]}, [("$", None, SQUARE[:3])]),
    ({"poly": [{"x": 10, "y": 20}, {"x": 30}, {"x": 30, "y": 60}]}, [("$", None, "skipped_geom")]),
    ({"points": [[10, 20], [30, 20], [30]]}, [("$", None, "skipped_geom")]),
    ({"points": [[10, 20, 5], [30, 20, 5], [30, 60, 5]]}, [("$", None, SQUARE[:3])]),
    ({"points": [[30, 60], [10, 20]]}, [("$", None, SQUARE)]),
    ({"points": [[30, 60], [30, 20]]}, [("$", None, "skipped_geom")]),
    ({"bbox": [10, 20, 20, 40]}, [("$", None, SQUARE)]),
    ({"bbox": [-10, -20, -5, -1]}, [("$", None, "skipped_invalid")]),
    ({"box": {"xmin": 10, "ymin": 20, "xmax": 30, "ymax": 60}}, [("$", None, SQUARE)]),
    ({"rect": {"x": 10, "y": 20, "w": 20, "h": 40}}, [("$", None, SQUARE)]),
    ({"bndbox": {"left": 10, "top": 20, "right": 30, "bottom": 60}}, [("$", None, SQUARE)]),
    ({"bbox": {"left": 10, "top": 20}}, [("$", None, "skipped_geom")]),
    ({"bbox": [5, 5, 5, 0]}, [("$", None, "skipped_geom")]),
    ({"polygon": "none", "vertices": SQUARE}, [("$", None, SQUARE)]),
    ({"polygon": None, "bbox": [10, 20, 20, 40]}, [("$", None, SQUARE)]),
    ({"center": [50, 40], "r": 8}, [("$", None, ring(50, 40, 8))]),
    ({"cx": 50, "cy": 40, "radius": "8"}, [("$", None, ring(50, 40, 8))]),
    ({"cx": 50, "cy": 40, "r": "?", "rad": 8}, [("$", None, "skipped_geom")]),
    ({"cx": 50, "cy": 40}, []),
    ({"shape_type": "Circle", "points": [[50, 40], [56, 48]]}, [("$", None, ring(50, 40, 10))]),
    ({"shape_type": "rectangle", "points": [[10, 20], [30, 60]]}, [("$", None, SQUARE)]),
    # labels by order of keys, not of appearance; unusable values pass on to the next key
    ({"class": "defect", "case": "기공", "points": SQUARE}, [("$", "기공", SQUARE)]),
    ({"case": 1.5, "defect": [], "label": "Gas-Pore", "points": SQUARE}, [("$", "gas_pore", SQUARE)]),
    ({"category": {"id": 3, "Name": " Blow Hole "}, "points": SQUARE}, [("$", "blowhole", SQUARE)]),
    ({"type": 7, "points": SQUARE}, [("$", "7", "skipped_label")]),
    ({"label": "normal", "points": SQUARE}, [("$", "normal", "skipped_label")]),
    ({"label": "crack", "points": SQUARE}, [("$", "crack", "skipped_label")]),
    # thin and repeated points
    ({"points": [[10, 20], [10, 20], [30, 60]]}, [("$", None, "skipped_invalid")]),
    ({"points": [*SQUARE, SQUARE[0]]}, [("$", None, SQUARE)]),
    # nested nodes are nodes, too; brackets in strings are no levels
    ({"bbox": [10, 20, 20, 40], "parts": [{"x]}[{": [[{"seg": SQUARE[:3]}]]}]}, [("$", None, SQUARE), ("$.parts[0].x]}[{[0][0]", None, SQUARE[:3])]),
    ([[{"points": SQUARE}], 3, {"a": {"points": SQUARE[:3]}}], [("$[0][0]", None, SQUARE), ("$[2].a", None, SQUARE[:3])]),
    ({"a": [1, 2], "b": "points"}, []),
    ([], []),
]


def found(rows):
    out = {}
    for r in rows:
        px = [[p["x"] * 100, p["y"] * 80] for p in r["points"]] if r["points"] else r["outcome"]
        out.setdefault(r["no"], []).append((r["path"], r["label"], px))
    return out


def test_every_layout(spark):
    files = spark.createDataFrame([(i, json.dumps(x, ensure_ascii=i % 2 == 0), 100, 80) for i, (x, _) in enumerate(CASES)], "no int, text string, w int, h int")
    got = found(A.extracted(files).collect())
    for i, (x, expected) in enumerate(CASES):
        rows = sorted(got.get(i, []), key=lambda r: r[0])
        assert [r[:2] for r in rows] == [e[:2] for e in expected], x
        for (_, _, a), (_, _, b) in zip(rows, expected):
            assert a == b if isinstance(b, str) else [q for p in a for q in p] == pytest.approx([q for p in b for q in p], abs=1e-4), x


def test_outcomes_of_files(spark):
    texts = ["﻿" + json.dumps({"points": SQUARE}), "{broken", None, "", json.dumps({"label": "ok", "points": SQUARE}), json.dumps({"points": [[0.1, 0.1], [0.5, 0.1], [0.5, 0.9]]})]
    files = spark.createDataFrame([(i, t, 100, 80) for i, t in enumerate(texts)] + [(9, texts[0], 0, 80)], "no int, text string, w int, h int").withColumn("label_id", F.lit(1))
    rows = A.extracted(files)
    got = {r["no"]: (r["outcome"], r["points"] and len(r["points"])) for r in rows.collect()}
    assert got == {0: ("matched", 4), 1: ("error", None), 2: ("error", None), 3: ("error", None), 4: ("skipped_label", None), 5: ("matched", 3), 9: ("skipped_invalid", None)}
    assert [tuple(r) for r in A.counters(rows, "label_id").collect()] == [(1, 4, 2, 1, 0, 1, 3)]
    strict = A.extracted(files, default=False)
    assert A.counters(strict).first()["skipped_label"] == 4


def test_no_files(spark):
    files = spark.createDataFrame([], "no int, text string, w int, h int")
    assert A.extracted(files).collect() == []


def test_deep_nesting_and_plan(spark):
    deep = {"points": SQUARE}
    for k in range(30):
        deep = {"level": deep} if k % 2 else [k, deep]
    files = spark.createDataFrame([(1, json.dumps(deep), 100, 80)], "no int, text string, w int, h int")
    rows = A.extracted(files)
    assert [r["outcome"] for r in rows.collect()] == ["matched"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_a_polygon_reads_each_number_of_its_node_a_few_times(spark):
    files = spark.createDataFrame([(1, '{"center":[1,2],"r":3}', 100, 100)], "id int, text string, w int, h int")
    plan = A.extracted(files, levels=1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") < 100  # 383 before
