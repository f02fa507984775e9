"""One JSON document from many rows: judged label files, histories."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions import geometry as G
from seamline.operators.order import numbered
from seamline.sources.tables import kept

# Codes of methods and classes, the classes' names in label files, the class of sound regions.
METHOD_CODES = {"RT": 0, "VT": 1}
CLASS_CODES = {"none": 0, "porosity": 1, "slag": 2, "lof": 3, "crack": 4, "lp": 5, "undercut": 6}
CLASS_NAMES = {"정상": "none", "균열": "crack", "기공": "porosity", "융합불량": "lof", "슬래그혼입": "slag", "용입부족": "lp", "언더컷": "undercut"}
SOUND = "normal"


def looked_up(value: Column, table: dict, default) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.coalesce(value, F.lit(""))], F.lit(default))


def method(kind: Column) -> Column:
    """VT where the type starts with it in either case, else RT."""
    return F.when(F.upper(kind).startswith("VT"), "VT").otherwise("RT")


def sampled(files: DataFrame, share: float, key: str = "path", seed: int = 42) -> DataFrame:
    """Each file with chance `share`, by the first 32 bits of MD5("seed:path"): the same
    files on every run and in any order."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), 1, 8), 16, 10).cast("long")
    return files if share >= 1 else files.where(h < int(share * 2**32))


def records(labels: DataFrame) -> DataFrame:
    """path, method, cls and majors (pixels, in the file's order) of parsed label files, a
    row for each path: of annotations that are not sound regions, the largest distance of
    two points, if above 0. Points that x and y don't both have are left out."""
    rows = labels.select("path", method(F.col("info.type")).alias("method"), looked_up(F.col("image_data.information"), CLASS_NAMES, "none").alias("cls"), F.posexplode_outer("annotations").alias("no", "a"))
    points = F.transform(F.arrays_zip(F.col("a.coordinate.x").alias("x"), F.col("a.coordinate.y").alias("y")), lambda z: F.struct(z["x"].alias("x"), z["y"].alias("y")))
    whole = F.filter(F.coalesce(points, F.array().cast(G.POINTS)), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    sized = rows.withColumn("points", F.when(~F.col("a.class").eqNullSafe(SOUND), whole)).withColumn("d", G.major_diameter(F.col("points")))
    found = F.sort_array(F.collect_list(F.when(F.col("d") > 0, F.struct("no", "d"))))
    return sized.groupBy("path", "method", "cls").agg(F.transform(found, lambda x: x["d"]).alias("majors"))


def payload_rows(recs: DataFrame) -> DataFrame:
    """path, n_defects and row: method code, class code, sizes to whole pixels (halves to
    even). Unknown methods count as RT, unknown classes as porosity."""
    codes = F.array(looked_up(F.col("method"), METHOD_CODES, METHOD_CODES["RT"]), looked_up(F.col("cls"), CLASS_CODES, CLASS_CODES["porosity"]))
    return recs.select("path", F.size("majors").alias("n_defects"), F.concat(codes, F.transform("majors", lambda d: F.bround(d).cast("int"))).alias("row"))


def payload(labels: DataFrame, source: str, share: float = 1.0) -> DataFrame:
    """The lines (place, value) of the payload document of label files."""
    rows = kept(payload_rows(records(labels)), "payload")
    n, defects = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_defects"), F.lit(0))).first()
    head = {"source": source, "n_images_total": n, "n_defects_total": defects, "sample_rate": share, "n_sample": n, "type_codes": METHOD_CODES, "class_codes": CLASS_CODES}
    return document(head, {"rows": rows.select("path", F.to_json("row").alias("json"))})


def document(head: dict, lists: dict[str, DataFrame]) -> DataFrame:
    """Lines (place, value) that make one compact JSON object when put one after the other:
    the fields of head, then each list. A list's rows (json and the columns that
    give its order, the first ones first) are numbered in ranges, so none passes through one task."""
    spark = next(iter(lists.values())).sparkSession
    opening = json.dumps(head, ensure_ascii=False, separators=(",", ":"))[:-1]
    lines, at = None, 0
    for k, (name, rows) in enumerate(lists.items()):
        opening += ("," if head or k else "") + json.dumps(name, ensure_ascii=False) + ":["
        ordered = kept(numbered(rows, *(F.col(c) for c in rows.columns if c != "json"), name="_place"), "document")
        first = spark.createDataFrame([(at, opening)], "place long, value string")
        body = ordered.select((F.col("_place") + at).alias("place"), F.concat(F.when(F.col("_place") > 1, ",").otherwise(""), "json").alias("value"))
        lines = first.union(body) if lines is None else lines.union(first).union(body)
        at, opening = at + 1 + ordered.count(), "]"
    return lines.union(spark.createDataFrame([(at, "]}")], "place long, value string"))


def write_document(lines: DataFrame, path: str) -> None:
    """Text files whose contents, in the order of their names, are the document."""
    lines.repartitionByRange("place").sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)
