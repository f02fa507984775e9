"""Readers and writers of the catalogue, label JSON, chunks, indexes and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators.dataset import with_shape

CATALOGUE = "label_id BIGINT, filename STRING, image_path STRING, label_path STRING, type STRING, material STRING, class STRING, width INT, height INT, is_crowd INT, annotation_case STRING, num_annotations INT, split STRING, image_exists BOOLEAN"
LABEL = "info STRUCT<id: BIGINT, type: STRING, material: STRING>, image_data STRUCT<file_name: STRING, format: STRING, width: INT, height: INT, information: STRING>, meta STRUCT<is_crowd: INT, annotation_case: ARRAY<STRING>>, annotations ARRAY<STRUCT<tool: STRING, coordinate: STRUCT<x: ARRAY<DOUBLE>, y: ARRAY<DOUBLE>>, class: STRING, `case`: STRING>>"


REQUIRED = ("label_id", "filename", "width", "height", "is_crowd", "annotation_case", "split", "image_exists")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The image catalogue with is_tile, croppable and aspect. Columns are found by name,
    without blanks or a byte order mark around them; missing ones that selections
    need and repeated ids are errors. Other known columns are null where absent."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*(c.lstrip("\ufeff").strip() for c in raw.columns))
    if missing := [c for c in REQUIRED if c not in raw.columns]:
        raise ValueError(f"columns missing from the catalogue: {missing}")
    kinds = [c.split(" ") for c in CATALOGUE.split(", ")]
    df = raw.select(*((F.col(f"`{c}`") if c in raw.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds))
    repeated = df.groupBy("label_id").count().where("count > 1").count()
    if repeated:
        raise ValueError(f"label_id is not unique: {repeated} repeated")
    return with_shape(df).withColumn("aspect", F.col("width") / F.col("height"))


def write_catalogue(df: DataFrame, path: str) -> None:
    """CSV files, each with a byte order mark and a header."""
    first, *rest = df.columns
    df.select(F.col(f"`{first}`").alias(f"\ufeff{first}"), *(f"`{c}`" for c in rest)).write.mode("overwrite").csv(path, header=True)


def read_label_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of every JSON file below a folder; text is null where it is no UTF-8.
    Spark's readers pass over files of no bytes, so these are not reported."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.json").load(path)
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def judged_labels(files: DataFrame) -> DataFrame:
    """path, the parts of the label (null where they are not there) and reason: null for files
    in the known form, else why a file is no label."""
    needed = {"info": "info", "image_data": "image_data", "meta": "meta", "file_name": "image_data.file_name", "format": "image_data.format"}
    read = F.struct(F.from_json("text", LABEL, {"mode": "PERMISSIVE"}).alias("doc"), F.try_parse_json("text").isNotNull().alias("json"))
    # through an explode, so that no later filter or projection parses the text again
    rows = files.select("path", F.explode(F.array(read)).alias("_x")).select("path", "_x.doc.*", F.col("_x.json").alias("json"))
    lacks = F.concat_ws(", ", *(F.when(F.col(at).isNull(), name) for name, at in needed.items()))
    return rows.withColumn("reason", F.when(~F.col("json"), "no JSON").when(lacks != "", F.concat(F.lit("without "), lacks))).drop("json")


def parsed_labels(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, errors) of files (path, text): those in the known form, and path and reason
    of those that are no JSON or lack a part that a catalogue row needs."""
    rows = judged_labels(files)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("path", "reason")


def image_name() -> Column:
    return F.concat_ws(".", "image_data.file_name", "image_data.format")


def catalogue_rows(labels: DataFrame, images: DataFrame, split: str) -> DataFrame:
    """Catalogue rows from labels; images (file_name, with its ending) tells which images exist."""
    known = images.select(F.col("file_name").alias("known")).distinct()
    rows = labels.withColumn("name", image_name()).join(known, F.col("name") == F.col("known"), "left")
    return rows.select(
        F.col("info.id").alias("label_id"), F.col("name").alias("filename"), F.concat(F.lit(f"images/{split}/"), "name").alias("image_path"), F.concat(F.lit(f"labels/{split}/"), F.substring_index("path", "/", -1)).alias("label_path"),
        F.col("info.type").alias("type"), F.col("info.material").alias("material"), F.col("image_data.information").alias("class"), F.col("image_data.width").alias("width"), F.col("image_data.height").alias("height"), F.col("meta.is_crowd").alias("is_crowd"),
        F.coalesce(F.array_join("meta.annotation_case", ","), F.lit("")).alias("annotation_case"), F.coalesce(F.size("annotations"), F.lit(0)).alias("num_annotations"), F.lit(split).alias("split"), F.col("known").isNotNull().alias("image_exists"),
    )


def catalogued(files: DataFrame, images: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """(catalogue rows, errors): errors (label_path, reason) are the unreadable label files,
    which have no row, and the missing images, whose rows stay."""
    rows = judged_labels(files)
    path = F.concat(F.lit(f"labels/{split}/"), F.substring_index("path", "/", -1)).alias("label_path")
    known = images.select(F.col("file_name").alias("known")).distinct()
    # all faults in one pass; unreadable files meet no image, and go by their path so that they are spread
    named = rows.select(path, "reason", image_name().alias("name"), F.when(F.col("reason").isNull(), image_name()).otherwise(F.concat(F.lit("\0"), "path")).alias("key"))
    met = named.join(known, F.col("key") == F.col("known"), "left")
    reason = F.coalesce("reason", F.when(F.col("known").isNull(), F.concat(F.lit("no image "), "name")))
    return catalogue_rows(rows.where("reason is null").drop("reason"), images, split), met.select("label_path", reason.alias("reason")).where("reason is not null")


def polygons(labels: DataFrame) -> DataFrame:
    """One row per annotation: path, no, class and points."""
    a = labels.select("path", F.posexplode_outer("annotations").alias("no", "a")).where("a is not null")
    points = F.transform(F.arrays_zip(F.col("a.coordinate.x").alias("x"), F.col("a.coordinate.y").alias("y")), lambda z: F.struct(z["x"].alias("x"), z["y"].alias("y")))
    whole = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return a.select("path", "no", F.col("a.class").alias("class"), F.when(F.size(whole) >= 3, whole).alias("points"))


def json_keys(rows: DataFrame, text: str) -> DataFrame:
    """Keys of JSON objects with counts and value kinds."""
    keys = rows.select(F.explode(F.from_json(text, "map<string,string>")).alias("key", "value"))
    kind = F.when(F.col("value").isNull(), "null").when(F.col("value").rlike(r"^-?\d+$"), "integer").when(F.col("value").rlike(r"^-?\d+\.\d+$"), "number").otherwise("string")
    return keys.groupBy("key", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines; chunk_no keeps their order."""
    chunks.write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def manifest(chunks: DataFrame, settings: dict[str, int]) -> DataFrame:
    """One row: number of chunks, the sorted (document, edition) pairs, settings."""
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.sort_array(F.collect_set(F.struct("doc_id", "edition"))).alias("documents")).withColumns({k: F.lit(v) for k, v in settings.items()})


CONTRACT = "schema_version STRING, decision_conf DOUBLE, min_instances INT, infer STRUCT<imgsz: INT, conf: DOUBLE, iou: DOUBLE, max_det: INT>, metrics_on_heldout STRUCT<thr: DOUBLE, tp: BIGINT, fp: BIGINT, fn: BIGINT, tn: BIGINT, precision: DOUBLE, recall: DOUBLE, specificity: DOUBLE, fpr: DOUBLE, f1: DOUBLE, accuracy: DOUBLE, balanced: DOUBLE>"


def write_contract(contract: DataFrame, path: str) -> None:
    contract.coalesce(1).write.mode("overwrite").json(path)


def read_contract(spark: SparkSession, path: str, version: str = "1.0") -> DataFrame:
    """The one row of a threshold contract; another version, no threshold or several rows are errors."""
    rows = spark.read.schema(CONTRACT).json(path)
    found = rows.select("schema_version", "decision_conf").limit(2).collect()
    if len(found) != 1 or found[0]["schema_version"] != version or found[0]["decision_conf"] is None:
        raise ValueError(f"no threshold contract of version {version} in {path}")
    return rows


SOURCE = "doc_id STRING, short STRING, title STRING, publisher STRING, edition STRING, effective_date STRING, source_url STRING, url STRING, path STRING, license STRING, doc_type STRING, guidance_doc_id STRING, part STRING, part_title STRING, chapters ARRAY<STRING>, doc_types ARRAY<STRING>, tables_json STRING, skip BOOLEAN, note STRING"


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """The registry of sources, a YAML file with a list `sources`, in its order (`no`). A registry
    is a setting of a few entries, so the driver reads it. Unknown keys are left out, absent
    ones null, and skip false; entries without or with a repeated doc_id are errors."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    entries = (yaml.safe_load(text) or {}).get("sources") or []
    ids = [e.get("doc_id") for e in entries]
    if None in ids or len(set(ids)) < len(ids):
        raise ValueError(f"sources without or with a repeated doc_id in {path}")
    kinds = [f.split(" ") for f in SOURCE.split(", ")]

    def value(x, kind: str):
        if kind == "BOOLEAN":
            return bool(x)
        if x is None or kind == "STRING":
            return None if x is None else str(x)
        return [str(v) for v in (x if isinstance(x, list) else [x])]

    return spark.createDataFrame([(no, *(value(e.get(k), kind) for k, kind in kinds)) for no, e in enumerate(entries)], f"no INT, {SOURCE}")
