"""Queries: image headers, check of a split, places of labels, threshold contract, registry of sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators import dataset as D
from seamline.operators import evaluation as E
from seamline.operators import regulation as R
from seamline.plans.detection import registry
from seamline.plans.judging import SWEEP, V_SCORES, scores
from seamline.plans.labels import V_FILE, catalogue
from seamline.plans.proxies import table
from seamline.sources import files as S
from seamline.sources.images import with_size
from seamline.sources.tables import work_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def image_files(spark: SparkSession, sf: str) -> DataFrame:
    """A PNG, JPEG, BMP or TIFF header for each image that exists; some are cut off."""
    k = F.col("label_id")
    n = lambda c, digits: F.lpad(F.hex(F.col(c).cast("long")), digits, "0")

    def little(c: str) -> Column:
        h = n(c, 8)
        return F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))

    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), n("width", 8), n("height", 8))
    jpeg = F.concat(F.lit("FFD8FFE000064A464946FFFFC4000300FFC0001108"), n("height", 4), n("width", 4), F.lit("03"))
    bmp = F.concat(F.lit("424D"), F.repeat(F.lit("00"), 12), F.lit("28000000"), little("width"), little("height"))
    tiff = F.concat(F.lit("4D4D002A000000080002"), F.lit("0100000400000001"), n("width", 8), F.lit("0101000400000001"), n("height", 8))
    kind = F.when(k % 4 == 0, png).when(k % 4 == 1, jpeg).when(k % 4 == 2, bmp).otherwise(tiff)
    content = F.unhex(F.when(k % 23 == 0, F.substring(kind, 1, 20)).otherwise(kind))
    return catalogue(spark, sf).where("image_exists").select("label_id", "split", D.stem(F.col("filename")).alias("stem"), content.alias("content"))


@query(f"WITH {V_FILE} SELECT label_id, split, stem, CASE WHEN label_id % 23 <> 0 THEN w END AS width, CASE WHEN label_id % 23 <> 0 THEN h END AS height FROM v_catalogue WHERE image_exists")
def image_sizes(spark, sf):
    return with_size(image_files(spark, sf))


#: Label files by the id modulo nine, and their bad lines and lines with bad coordinates.
FORMS = [
    ("", 0, 0), ("0 0.1 0.1 0.2 0.1 0.2", 1, 0), ("0 0.1 0.1 0.2 0.1 0.2 0.2 0.3", 1, 0), ("0 0.1 0.1 0.2 x 0.2 0.2", 1, 0), ("0 0.1 0.1 1.5 0.1 0.2 0.2\n0 -0.1 0.1 0.2 0.1 0.2 0.2", 0, 2),
    ("0 0.1 0.1 0.2 0.1 0.2 0.2\n0 1 2", 1, 0), ("0 0.1 0.1 1.0000005 0.1 0.2 0.2", 0, 0), ("\n0 0.1 0.1 0.2 0.1 0.2 0.2\n\n0 0.1  0.1 0.2\t0.1 9 0.2\n", 0, 1), ("\n \n", 0, 0),
]


@query(f"""WITH {V_FILE}, v_check AS (SELECT split, image_exists AS a, label_id % 13 <> 0 AS b, label_id % 9 AS form, NOT is_tile OR label_id % 23 = 0 AS wrong FROM v_catalogue)
SELECT split, count(*) FILTER (a) AS n_images, count(*) FILTER (b) AS n_labels, count(*) FILTER (a AND NOT b) AS image_without_label, count(*) FILTER (b AND NOT a) AS label_without_image, count(*) FILTER (b AND form IN (0, 8)) AS empty_labels,
count(*) FILTER (b AND form IN (1, 2, 3, 5)) AS bad_lines, (count(*) FILTER (b AND form IN (4, 7)) + count(*) FILTER (b AND form = 4)) AS bad_coords, count(*) FILTER (a AND wrong) AS wrong_size, count(*) FILTER (a) AS size_checked FROM v_check GROUP BY split""")
def split_check(spark, sf):
    text = F.get(F.array(*(F.lit(t) for t, _, _ in FORMS)), (F.col("label_id") % 9).cast("int"))
    labels = catalogue(spark, sf).where("label_id % 13 <> 0").select("split", D.stem(F.col("filename")).alias("stem"), text.alias("text"))
    return D.split_report(with_size(image_files(spark, sf)), labels)


@query(f"""WITH {V_FILE} SELECT l_orderkey * 2 AS label_id, l_linenumber AS rank, 'labels/' || split || '/' || label_id || '.json' AS label_path, w AS width, h AS height
FROM lineitem LEFT JOIN v_catalogue ON label_id = l_orderkey * 2""")
def label_lookup(spark, sf):
    """Labels of cases that a search has found, here the lines of orders; some are not listed."""
    found = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 2).alias("label_id"), F.col("l_linenumber").alias("rank"))
    listed = catalogue(spark, sf).withColumn("label_path", F.concat(F.lit("labels/"), "split", F.lit("/"), "label_id", F.lit(".json")))
    return D.label_places(found, listed)


FOLD = "('0x' || substr(md5('42:' || stem), 1, 8))::BIGINT % 2"


@query(f"""WITH {V_SCORES}, grid AS (SELECT round(0.01::DOUBLE + i * 0.01::DOUBLE, 3) AS thr FROM range(0, 95) r(i)),
x AS (SELECT thr, fold, count(*) FILTER (label = 1 AND p) AS tp, count(*) FILTER (label = 0 AND p) AS fp, count(*) FILTER (label = 1 AND NOT p) AS fn, count(*) FILTER (label = 0 AND NOT p) AS tn FROM (SELECT thr, label, {FOLD} AS fold, len(list_filter(confs, lambda c: c >= thr)) >= 1 AS p FROM v_scores, grid) GROUP BY ALL),
y AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall FROM x), z AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM y),
a AS (SELECT thr FROM z WHERE fold = 0 AND recall >= 0.6 ORDER BY precision DESC, thr DESC LIMIT 1), b AS (SELECT thr FROM z WHERE fold = 0 ORDER BY f1 DESC, thr DESC LIMIT 1), c AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a))
SELECT '1.0' AS schema_version, c.thr AS decision_conf, 1 AS min_instances, 1280 AS imgsz, 0.15::DOUBLE AS conf, 0.5::DOUBLE AS iou, 300 AS max_det, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM c JOIN z ON z.thr = c.thr AND fold = 1""")
def threshold_contract(spark, sf):
    """Threshold chosen on one fold, rates from the other; written, read back."""
    rows = scores(spark, sf).withColumn("fold", E.fold(F.col("stem")))
    point = E.operating_point(E.sweep(rows.where("fold = 'tune'")), 0.6)
    path = f"{work_folder(spark)}/seamline-contract-{uuid.uuid4().hex}"
    S.write_contract(E.contract(point, rows.where("fold = 'test'")), path)
    m = F.col("metrics_on_heldout")
    return S.read_contract(spark, path).select("schema_version", "decision_conf", "min_instances", "infer.*", *(m[c].alias(c) for c in ("tp", "fp", "fn", "tn")), *(F.round(m[c], 6).alias(c) for c in ("precision", "recall", "f1")))


@query("""SELECT c_custkey, 's' || c_nationkey AS source, CASE WHEN c_custkey % 4 = 0 AND c_nationkey % 2 = 0 THEN 'g' || c_nationkey ELSE 'r' || c_nationkey END AS doc_id, c_mktsegment AS chapter, CASE WHEN c_custkey % 4 = 0 THEN 'guidance' ELSE 'rule' END AS doc_type
FROM customer WHERE c_nationkey % 7 <> 0 AND (c_nationkey % 3 <> 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY')) AND (c_nationkey % 5 <> 0 OR c_custkey % 4 <> 0)""")
def source_registry(spark, sf):
    """Nodes picked by a registry file, which is written and read here; JSON is YAML too."""
    entry = F.to_json(F.struct(F.concat(F.lit("s"), "source").alias("doc_id"), "skip", "chapters", "doc_types", "guidance_doc_id"))
    text = registry(spark, sf).select(entry.alias("e"), "source").agg(F.concat(F.lit('{"sources":['), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "e"))), lambda x: x["e"]), ","), F.lit("]}")).alias("value"))
    path = f"{work_folder(spark)}/seamline-registry-{uuid.uuid4().hex}"
    text.coalesce(1).write.text(path)
    sources = S.read_sources(spark, path).withColumnRenamed("doc_id", "source")
    k = F.col("c_custkey")
    nodes = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("s"), "c_nationkey").alias("source"), F.concat(F.lit("r"), "c_nationkey").alias("doc_id"), F.col("c_mktsegment").alias("chapter"), F.when(k % 4 == 0, "guidance").otherwise("rule").alias("doc_type"))
    return R.selected_nodes(nodes, sources.select("source", "skip", "chapters", "doc_types", "guidance_doc_id"))
