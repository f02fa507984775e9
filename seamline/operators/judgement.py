"""Margins, grades and verdicts of images from their defects' sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions import acceptance as A


def porosity_margin(defects: DataFrame, by=("image", "t"), d: str = "d") -> DataFrame:
    """Per image the number of counting defects, point sum, largest size, and the
    margin: the larger of points and size over their limits (0 without counting
    defects), as raw and rounded to 4; rules go by raw. One shuffle by image, partially
    aggregated; no window."""
    t = F.col("t")
    got = defects.groupBy(*by).agg(*(v.alias(k) for k, v in counted(F.col(d), t).items()))
    raw = raw_margin(F.col("n"), F.col("points"), F.col("max_d"), t)
    return got.withColumn("raw", raw).withColumn("margin", F.round("raw", 4))


def counted(size: Column, t: Column) -> dict[str, Column]:
    """Number, point sum and largest size of the counting defects, as aggregates."""
    counts = size > A.ignored_up_to(t)
    return {"n": F.count_if(counts), "points": F.coalesce(F.sum(F.when(counts, A.points(size))), F.lit(0)), "max_d": F.coalesce(F.max(F.when(counts, size)), F.lit(0.0))}


def raw_margin(n: Column, points: Column, largest: Column, t: Column) -> Column:
    return F.when(n == 0, 0.0).otherwise(F.greatest(points / A.point_limit(t), largest / A.size_limit(t)))


#: Fixed value: the margin of an image with a crack, which never passes.
CRACK_MARGIN = 3.0


def with_cracks(images: DataFrame, crack: Column) -> DataFrame:
    """images with raw and margin of those with a crack set to theirs, and rule (1: fails) by raw."""
    of = lambda c: F.when(crack, CRACK_MARGIN).otherwise(F.col(c))
    return images.withColumns({"raw": of("raw"), "margin": of("margin")}).withColumn("rule", (F.col("raw") > 1).cast("int"))


def elongated_margin(defects: DataFrame, by=("image", "t"), length: str = "d") -> DataFrame:
    """Per image the summed length over the length limit."""
    return defects.groupBy(*by).agg(F.sum(length).alias("length")).withColumn("margin", F.round(F.col("length") / A.length_limit(F.col("t")), 4))


def judged(images: DataFrame, spacing: str = "spacing", hard: Column | None = None, bounds=A.GRADES) -> DataFrame:
    """Verdict and grade: held without a pixel spacing, else failed when hard or the
    rounded margin exceeds 1. Verdict literals are data values."""
    known = F.col(spacing).isNotNull()
    fails = (F.col("margin") > 1) if hard is None else hard | (F.col("margin") > 1)
    return images.select(
        *[c for c in images.columns if c != "margin"],
        F.when(known, F.col("margin")).alias("margin"),
        F.when(known, A.grade(F.col("margin"), hard, bounds)).alias("grade"),
        F.when(~known, "보류").when(fails, "불합격").otherwise("합격").alias("verdict"),
    )


def audited(defects: DataFrame, by=("image", "t"), major: str = "major", equivalent: str = "equivalent") -> DataFrame:
    """Both margins of each image, and whether the verdict would flip to passed if
    the equivalent instead of the major diameter were taken. One aggregation."""
    t = F.col("t")

    def parts(name: str, tag: str) -> list[Column]:
        size = F.col(name)
        counts = size > A.ignored_up_to(t)
        return [F.coalesce(F.sum(F.when(counts, A.points(size))), F.lit(0)).alias(f"p_{tag}"), F.coalesce(F.max(F.when(counts, size)), F.lit(0.0)).alias(f"m_{tag}")]

    got = defects.groupBy(*by).agg(*parts(major, "a"), *parts(equivalent, "b"))
    margin = lambda tag: F.round(F.greatest(F.col(f"p_{tag}") / A.point_limit(t), F.col(f"m_{tag}") / A.size_limit(t)), 4)
    got = got.withColumns({"margin_major": margin("a"), "margin_equivalent": margin("b")})
    return got.withColumn("flipped", (F.col("margin_major") > 1) & (F.col("margin_equivalent") <= 1)).drop("p_a", "m_a", "p_b", "m_b")


def sensitivity(defects: DataFrame, thicknesses: list[float], scales: list[float], d: str = "d") -> DataFrame:
    """Share of rejected images for each thickness and scale. An image's defects are counted
    for the whole grid at once, so only a row per image and task is shuffled."""
    grid = [(float(t), float(scale)) for t in thicknesses for scale in scales]
    each = [F.struct(*(v.alias(k) for k, v in counted(F.col(d) * scale, F.lit(t)).items())).alias(f"c{i}") for i, (t, scale) in enumerate(grid)]
    images = defects.groupBy("image").agg(*each)

    def failed(i: int, t: float, scale: float) -> Column:
        c = F.col(f"c{i}")
        return F.count_if(F.round(raw_margin(c["n"], c["points"], c["max_d"], F.lit(t)), 4) > 1).alias(f"r{i}")

    found = images.agg(F.count(F.lit(1)).alias("images"), *(failed(i, t, scale) for i, (t, scale) in enumerate(grid)))
    rows = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(scale).alias("scale"), F.col(f"r{i}").alias("rejected")) for i, (t, scale) in enumerate(grid)))
    # without images no row, as in a grouping
    out = found.where("images > 0").select("images", F.explode(rows).alias("g")).select("g.t", "g.scale", "images", "g.rejected")
    return out.withColumn("reject_rate", F.round(F.col("rejected") / F.col("images"), 6))


def limits(thicknesses: DataFrame, t: str = "t") -> DataFrame:
    """All limits of each thickness."""
    x = F.col(t).cast("double")
    return thicknesses.select(x.alias("t"), A.field(x).alias("field"), A.size_limit(x).alias("size_limit"), A.point_limit(x).alias("point_limit"), A.length_limit(x).alias("length_limit"), A.ignored_up_to(x).alias("ignored_up_to"))
