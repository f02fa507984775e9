"""Case profiles: how an image's defects lie, and how large and long they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions import geometry as G
from seamline.functions import many_points
from seamline.operators.order import quantiles

# Fixed values of the distribution classes.
CLUSTER_EXTENT = 0.05
LEAST_LINEAR = 8
LINEAR_SHARE = 0.90


def size_thresholds(sizes: DataFrame, d: str = "d") -> DataFrame:
    """lo, hi: exact 33rd and 67th percentiles of the non-zero sizes (0, 0 without any)."""
    lo, hi = (q or 0.0 for q in quantiles(sizes.where(F.col(d) > 0), d, [0.33, 0.67]))
    return sizes.sparkSession.createDataFrame([(lo, hi)], "lo double, hi double")


def size_category(d: Column, lo: Column, hi: Column) -> Column:
    return F.when(d < lo, "소").when(d < hi, "중").otherwise("대")


def distribution(points: Column, w: Column, h: Column, few: Column | None = None) -> Column:
    """Struct of class, n, extent_ratio, mean_nn_norm, spread_ratio, linear_ratio
    (rounded to 4); the ratios are null where the class comes from n alone. few: measures
    of the points, where they are known."""
    n = F.size(points)
    known = lambda name, other: other if few is None else F.when(few.isNotNull(), few[name]).otherwise(other)
    extent = known("extent", G.major_diameter(points))
    share = F.when(F.sqrt(w * w + h * h) > 0, extent / F.sqrt(w * w + h * h)).otherwise(0.0)
    side = lambda a: F.array_max(F.transform(points, lambda p: p[a])) - F.array_min(F.transform(points, lambda p: p[a]))
    many = n >= 2
    measured = F.struct(
        n.alias("n"),
        F.when(many, share).alias("extent"),
        F.when(many, F.when(extent > 0, known("near", G.nearest_mean(points)) / extent).otherwise(0.0)).alias("near"),
        F.when(many, F.coalesce(F.try_divide(side("x") * side("y"), w * h), F.lit(0.0))).alias("spread"),
        F.when(n >= LEAST_LINEAR, known("linear", G.linearity(points))).alias("linear"),
    )

    def named(m: Column) -> Column:
        close = m["extent"] <= CLUSTER_EXTENT
        name = F.when(m["n"] == 0, "해당없음").when(m["n"] == 1, "단독").when(close, "군집").when(m["linear"] >= LINEAR_SHARE, "선상").otherwise("산재")
        return F.struct(name.alias("distribution"), m["n"].alias("n_instances"), F.round(m["extent"], 4).alias("extent_ratio"), F.round(m["near"], 4).alias("mean_nn_norm"), F.round(m["spread"], 4).alias("spread_ratio"), F.when(~close, F.round(m["linear"], 4)).alias("linear_ratio"))

    return F.get(F.transform(F.array(measured), named), F.lit(0))


def measured(rows: DataFrame, points: str = "points") -> DataFrame:
    """rows with _m, the measures of many_points for sets of up to PAIRS points, computed once."""
    return rows.withColumn("_m", many_points.measures(F.col(points), G.PAIRS, LEAST_LINEAR))


def profiles(instances: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """One profile per image from its instances (x, y, d, elongated, w, h): one
    aggregation by image; the thresholds are one row, whatever the input."""
    lo, hi = F.col("lo"), F.col("hi")
    rows = instances.join(F.broadcast(thresholds)) if "lo" not in instances.columns else instances
    cat = size_category(F.col("d"), lo, hi)
    share = lambda c: F.count_if(cat == c) / F.count(F.lit(1))
    got = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("x", "y"))).alias("points"),
        F.first("w").alias("w"),
        F.first("h").alias("h"),
        share("소").alias("small"),
        share("중").alias("medium"),
        share("대").alias("large"),
        F.avg(F.col("elongated").cast("double")).alias("elongated"),
        F.avg("d").alias("mean_d"),
    )
    return measured(got).select(*keys, distribution(F.col("points"), F.col("w"), F.col("h"), F.col("_m")).alias("s"), "small", "medium", "large", "elongated", "mean_d").select(*keys, "s.*", "small", "medium", "large", "elongated", "mean_d")


def main_size(small: Column, medium: Column, large: Column) -> Column:
    """The most frequent size; of equals the first."""
    return F.when((small >= medium) & (small >= large), "소").when(medium >= large, "중").otherwise("대")
