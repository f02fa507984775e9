"""Detected instances: table of measures, verdict of each image, tiles put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions import geometry as G


def guarded(conf: float, decision_conf: float, min_instances: int) -> None:
    """Settings under which every image or no image would be abnormal are refused."""
    if min_instances < 1:
        raise ValueError("min_instances must be 1 or more")
    if conf > decision_conf:
        raise ValueError("conf must not exceed decision_conf")


def instance_table(raw: DataFrame, decision_conf: float = 0.25) -> DataFrame:
    """A row per detection of decision_conf or more; raw has image, no, conf, box (x1, y1,
    x2, y2), polygon (points, null where the mask failed: the box stands in), w, h and
    spacing (mm a pixel, may be null). Numbered from 0 in each image by `no`."""
    x1, y1, x2, y2 = (F.get("box", F.lit(i)) for i in range(4))
    whole = F.coalesce(F.size("polygon") >= 3, F.lit(False))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rows = raw.where(F.col("conf") >= decision_conf).select(
        "image", "no", "conf", "box", "w", "h", "spacing",
        F.when(whole, "mask").otherwise("box").alias("origin"),
        F.when(whole, F.col("polygon")).otherwise(F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2))).alias("polygon"),
        F.when(whole, G.area(F.col("polygon"))).otherwise(F.greatest(F.lit(0.0), (x2 - x1) * (y2 - y1))).alias("area"),
    )
    rows = rows.withColumns({"d": G.equivalent_diameter(F.col("area")), "centre": G.centroid(F.col("polygon"))})
    return rows.select(
        "image", (F.row_number().over(W.partitionBy("image").orderBy("no")) - 1).alias("id"), "conf", "origin",
        F.transform("box", lambda v: F.round(v, 2)).alias("box"), F.transform("polygon", lambda p: F.struct(F.round(p["x"], 2).alias("x"), F.round(p["y"], 2).alias("y"))).alias("polygon"),
        F.round("area", 2).alias("area_px"), F.round(F.try_divide("area", F.col("w") * F.col("h")), 8).alias("area_ratio"),
        F.round("d", 3).alias("diameter_px"), F.round(F.col("d") * F.nullif("spacing", F.lit(0.0)), 4).alias("diameter_mm"),
        F.round("centre.x", 2).alias("cx"), F.round("centre.y", 2).alias("cy"), "w", "h",
    )


def image_verdicts(raw: DataFrame, images: DataFrame, conf: float = 0.1, decision_conf: float = 0.25, min_instances: int = 1) -> DataFrame:
    """A row per image of images (image, w, h): verdict, number and total area of the
    instances that count, and the highest confidence of all candidates, those below
    decision_conf included. Images without candidates are normal with score 0."""
    guarded(conf, decision_conf, min_instances)
    found = instance_table(raw, decision_conf).groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.sum("area_px").alias("total"))
    best = raw.groupBy("image").agg(F.max("conf").alias("score"))
    rows = images.join(best, "image", "left").join(found, "image", "left")
    n, total = F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0.0))
    return rows.select(
        "image", F.when(n >= min_instances, "abnormal").otherwise("normal").alias("verdict"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), n.alias("n_instances"),
        F.round(total, 2).alias("total_area"), F.round(F.try_divide(total, F.col("w") * F.col("h")), 8).alias("total_ratio"),
    )


def merged_tiles(found: DataFrame, images: DataFrame) -> DataFrame:
    """Instances of tiles (image, x0, y0, id, box, polygon, cx, cy, area_px) in the
    coordinates of their image, numbered row of tiles by row, with their share of the
    whole image. Instances that two tiles see both stay."""
    x0, y0 = F.col("x0"), F.col("y0")
    shifted = found.withColumns({
        "box": F.transform("box", lambda v, i: v + F.when(i % 2 == 0, x0).otherwise(y0)),
        "polygon": F.transform("polygon", lambda p: F.struct((p["x"] + x0).alias("x"), (p["y"] + y0).alias("y"))),
        "cx": F.col("cx") + x0, "cy": F.col("cy") + y0,
    })
    number = F.row_number().over(W.partitionBy("image").orderBy("y0", "x0", "id")) - 1
    rows = shifted.withColumn("id", number).drop("w", "h", "area_ratio").join(images.select("image", "w", "h"), "image", "left")
    return rows.withColumn("area_ratio", F.coalesce(F.round(F.try_divide("area_px", F.col("w") * F.col("h")), 10), F.lit(0.0)))


def merged_verdicts(merged: DataFrame, images: DataFrame, min_instances: int = 1) -> DataFrame:
    """image_verdicts() of merged tiles: the score is that of the instances that count."""
    guarded(0.0, 0.0, min_instances)
    found = merged.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.sum("area_px").alias("total"), F.max("conf").alias("best"))
    n, total = F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0.0))
    share = F.coalesce(F.round(F.try_divide(total, F.col("w") * F.col("h")), 10), F.lit(0.0))
    return images.join(found, "image", "left").select("image", F.when(n >= min_instances, "abnormal").otherwise("normal").alias("verdict"), F.round(F.coalesce("best", F.lit(0.0)), 6).alias("score"), n.alias("n_instances"), F.round(total, 2).alias("total_area"), share.alias("total_ratio"))
