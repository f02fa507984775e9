"""The case table: profiles of labelled images, stored in versions with their thresholds.

Two passes: the sizes of all defects give the thresholds, then every image gets its profile.
A version is a folder with `profiles` (Parquet) and `settings` (one JSON row: lo, hi, the unit of
sizes and whatever else is given); readers take the latest or a named one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions import geometry as G
from seamline.operators import annotations
from seamline.operators import profiles as P
from seamline.sources.tables import kept

PROFILE = "image bigint, verdict string, distribution string, n_instances int, extent_ratio double, mean_nn_norm double, spread_ratio double, linear_ratio double, small double, medium double, large double, elongated double, mean_d double, meta map<string,string>"
FIELDS = [x.split(" ")[0] for x in PROFILE.split(", ")]


def labelled_instances(images: DataFrame, files: DataFrame, spacing: float | None = None) -> DataFrame:
    """Defects of images (label_id, width, height) out of their label files: image, x, y (centre),
    d (mm, or pixels without a spacing), elongated, w, h. Images without a polygon have no rows."""
    found = annotations.extracted(images.select("label_id", "width", "height").join(files.select("label_id", "text"), "label_id"), "width", "height").where("outcome = 'matched'")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    px = found.select(F.col("label_id").alias("image"), w.alias("w"), h.alias("h"), G.scaled(F.col("points"), w, h).alias("p"))
    d = G.equivalent_diameter(G.area(F.col("p"))) * (spacing or 1.0)
    return px.select("image", G.centroid(F.col("p")).alias("c"), d.alias("d"), (G.shape(F.col("p")) == "길쭉한").alias("elongated"), "w", "h").select("image", "c.x", "c.y", "d", "elongated", "w", "h")


def normal_profiles(images: DataFrame) -> DataFrame:
    """Profiles of images without defects: the class of none, no ratios, all shares 0."""
    none = {"distribution": F.lit("해당없음"), "n_instances": F.lit(0)} | {c: F.lit(None).cast("double") for c in ("extent_ratio", "mean_nn_norm", "spread_ratio", "linear_ratio")} | {c: F.lit(0.0) for c in ("small", "medium", "large", "elongated", "mean_d")}
    return images.select(F.col("label_id").alias("image"), *(v.alias(k) for k, v in none.items()))


def built(images: DataFrame, files: DataFrame, spacing: float | None = None) -> tuple[DataFrame, dict]:
    """(profiles, settings) of images (label_id, filename, image_path, width, height, verdict);
    abnormal ones without a polygon are left out."""
    abnormal, normal = images.where("verdict = 'abnormal'"), images.where("verdict = 'normal'")
    rows = kept(labelled_instances(abnormal, files, spacing), "labelled-instances")
    lo, hi = P.size_thresholds(rows).first()
    thresholds = rows.sparkSession.createDataFrame([(lo, hi)], "lo double, hi double")
    both = P.profiles(rows, thresholds, ["image"]).withColumn("verdict", F.lit("abnormal")).unionByName(normal_profiles(normal).withColumn("verdict", F.lit("normal")))
    meta = images.select(F.col("label_id").alias("image"), F.create_map(F.lit("stem"), F.regexp_replace("filename", r"\.[^.]*$", ""), F.lit("label_id"), F.col("label_id").cast("string"), F.lit("image_path"), F.col("image_path")).alias("meta"))
    return both.join(meta, "image").select(*FIELDS), {"lo": lo, "hi": hi, "unit": "mm" if spacing else "px", "spacing": spacing}


def save(profiles: DataFrame, settings: dict, path: str, version: int) -> str:
    """Writes a version; one that is there already is an error."""
    at = f"{path}/version={version}"
    profiles.select(*FIELDS).write.parquet(f"{at}/profiles")
    kinds = {bool: "boolean", int: "bigint", float: "double"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'double' if v is None else 'string')}" for k, v in settings.items())
    profiles.sparkSession.createDataFrame([tuple(settings.values())], schema).write.option("ignoreNullFields", "false").json(f"{at}/settings")
    return at


def versions(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(int(x.getPath().getName().split("=")[1]) for x in found if x.getPath().getName().startswith("version="))


def load(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, dict]:
    """(profiles, settings) of a version, the latest by default."""
    at = f"{path}/version={versions(spark, path)[-1] if version is None else version}"
    return spark.read.schema(PROFILE).parquet(f"{at}/profiles"), spark.read.json(f"{at}/settings").first().asDict()


def to_json(*columns: str) -> Column:
    """A profile as a JSON text that keeps nulls."""
    return F.to_json(F.struct(*(columns or FIELDS)), {"ignoreNullFields": "false"})


def from_json(text: Column) -> Column:
    return F.from_json(text, PROFILE)
