"""Evaluation of decision thresholds over image scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.operators.order import running


def image_scores(images: DataFrame, instances: DataFrame) -> DataFrame:
    """Per image the largest confidence (0 without instances), count, largest area
    share and all confidences; images without instances stay."""
    got = instances.groupBy("stem").agg(F.max("conf").alias("score"), F.count(F.lit(1)).alias("n_inst"), F.max("area_ratio").alias("max_area_ratio"), F.sort_array(F.collect_list("conf"), asc=False).alias("confs"))
    return images.join(got, "stem", "left").select(*images.columns, F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_inst", F.lit(0)).alias("n_inst"), F.coalesce("max_area_ratio", F.lit(0.0)).alias("max_area_ratio"), F.coalesce("confs", F.array().cast("array<double>")).alias("confs"))


def fold(stem: Column, seed: int = 42) -> Column:
    """tune or test, by the parity of the first 32 bits of MD5("seed:stem")."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), stem.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.when(h % 2 == 0, "tune").otherwise("test")


def ratio0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def sweep(scores: DataFrame, low: float = 0.01, high: float = 0.95, step: float = 0.01, least: int = 1) -> DataFrame:
    """Confusion matrix and rates for every threshold of the grid.

    A row does not meet every threshold: it is predicted for all thresholds up to
    its least-th confidence, so rows are counted by that place of the grid and
    label, and the matrix is a running sum over the grid's few rows.
    """
    n = round((high - low) / step) + 1
    nth = F.coalesce(F.get(F.sort_array("confs", asc=False), F.lit(least - 1)), F.lit(-1.0))
    # number of grid thresholds that do not exceed it (compared as they are rounded)
    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(F.lit(low) + i * step, 3))
    reach = F.size(F.filter(grid, lambda g: g <= nth))
    cells = scores.groupBy(reach.alias("reach")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    every = scores.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("reach")).join(F.broadcast(cells), "reach", "left").na.fill(0)
    onward = W.orderBy("reach").rowsBetween(1, W.unboundedFollowing)
    upto = W.orderBy("reach").rowsBetween(W.unboundedPreceding, 0)
    held = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    out = every.select("reach", held("pos", onward).alias("tp"), held("neg", onward).alias("fp"), held("pos", upto).alias("fn"), held("neg", upto).alias("tn")).where(F.col("reach") < n)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.select(F.round(F.lit(low) + F.col("reach") * step, 3).alias("thr"), "tp", "fp", "fn", "tn", ratio0(tp, tp + fp).alias("precision"), ratio0(tp, tp + fn).alias("recall"), ratio0(tn, tn + fp).alias("specificity"), ratio0(fp, fp + tn).alias("fpr"))
    return out.select("*", ratio0(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), ratio0(tp + tn, tp + fp + fn + tn).alias("accuracy"), ((F.col("recall") + F.col("specificity")) / 2).alias("balanced"))


def operating_point(swept: DataFrame, min_recall: float = 0.97) -> DataFrame:
    """Of thresholds with enough recall the most precise (then the highest); if there
    are none, the best F1. One aggregate of the few grid rows."""
    row = F.struct(*swept.columns)
    best = swept.agg(F.max_by(row, F.when(F.col("recall") >= min_recall, F.struct("precision", "thr"))).alias("a"), F.max_by(row, F.struct("f1", "thr")).alias("b"))
    return best.select(F.coalesce("a", "b").alias("x")).select("x.*")


def auc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve by rank sums, and average precision. Rows are counted
    by distinct score first, then summed over the scores in order."""
    by = scores.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    run = running(by, F.desc("score"), tp="p", fp="n")
    # pairs won: positives above each negative, ties half
    got = run.agg(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("won"), F.sum("p").alias("pos"), F.sum("n").alias("neg"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    return got.select("pos", "neg", F.round(F.try_divide("won", F.col("pos") * F.col("neg")), 6).alias("roc_auc"), F.round(F.try_divide(F.col("ap"), F.col("pos")), 6).alias("average_precision"))


def false_positives(scores: DataFrame, threshold: float, by: str = "source") -> DataFrame:
    """False-positive rate of the negatives of each source."""
    return scores.where("label = 0").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= threshold).alias("fp")).withColumn("fpr", F.round(F.col("fp") / F.col("n"), 6))


def tiles(images: DataFrame, tile: tuple[int, int] = (1280, 720), overlap: float = 0.2) -> DataFrame:
    """Origins of overlapping tiles (width and height); the last of each axis is snapped to
    the edge, and an image smaller than a tile has one, padded to `padded_w`, `padded_h`."""

    def origins(side: Column, length: int) -> Column:
        last = F.greatest(side - length, F.lit(0))
        return F.array_union(F.sequence(F.lit(0), last, F.lit(max(1, int(length * (1 - overlap))))), F.array(last))

    rows = images.withColumns({"padded_w": F.greatest("width", F.lit(tile[0])), "padded_h": F.greatest("height", F.lit(tile[1]))})
    return rows.select("*", F.explode(origins(F.col("height"), tile[1])).alias("y")).select("*", F.explode(origins(F.col("width"), tile[0])).alias("x"))


# Version and inference settings of the threshold contract.
SCHEMA_VERSION = "1.0"
INFERENCE = {"imgsz": 1280, "conf": 0.15, "iou": 0.50, "max_det": 300}


def contract(point: DataFrame, held_out: DataFrame, least: int = 1, inference: dict = INFERENCE) -> DataFrame:
    """One row that verdicts are bound to: the threshold of `point` (one row with thr), how many
    instances it asks for, the settings it holds for, and the rates of the held-out fold at it
    (a row of the sweep over held_out; null if its grid lacks the threshold)."""
    swept = sweep(held_out, least=least)
    metrics = F.broadcast(swept.select("thr", F.struct(*swept.columns).alias("metrics_on_heldout")))
    return point.select("thr").join(metrics, "thr", "left").select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("thr").alias("decision_conf"), F.lit(least).alias("min_instances"), F.struct(*(F.lit(v).alias(k) for k, v in inference.items())).alias("infer"), "metrics_on_heldout"
    )
