"""Queries: annotations in label JSON of any shape, training sets, images for the case table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions import geometry as G
from seamline.operators import annotations as A
from seamline.operators import case_table as T
from seamline.operators import dataset as D
from seamline.operators import similarity as S
from seamline.plans.proxies import table
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


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """An image per order: tiles, panoramas and small ones; porosity, normal and cracks."""
    k = F.col("o_orderkey")
    size = lambda a, b, c: F.when(k % 4 < 2, a).when(k % 4 == 2, b).otherwise(c)
    rows = table(spark, sf, "orders").select(
        k.alias("label_id"), F.concat(F.lit("img."), k, F.lit(".jpg")).alias("filename"), size(1280, 5120, 640).alias("width"), size(720, 1440, 480).alias("height"), F.when(k % 11 == 0, 1).otherwise(0).alias("is_crowd"),
        F.when(k % 3 == 0, "porosity").when(k % 3 == 1, "normal").otherwise("crack").alias("annotation_case"), F.when(k % 10 < 8, "train").otherwise("val").alias("split"), (k % 17 != 0).alias("image_exists"),
    )
    return D.with_shape(rows)


def label_files(spark: SparkSession, sf: str) -> DataFrame:
    """A label file for most images: a square or circle in one of fourteen forms of JSON."""
    k, e = F.col("label_id"), F.format_string
    c = catalogue(spark, sf).where("label_id % 13 <> 0")
    unit = {"x0": k * 37 % 40 + 10, "y0": k * 53 % 20 + 5}
    unit |= {"x1": unit["x0"] + (k % 3 + 1) * 9, "y1": unit["y0"] + (k % 3 + 1) * 9}
    px = {n: (u * F.col("width" if n[0] == "x" else "height") / 80).cast("int") for n, u in unit.items()}
    c = c.select("label_id", "width", "height", *(v.alias(n) for n, v in px.items()))
    four = e("[[%d,%d],[%d,%d],[%d,%d],[%d,%d]]", "x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")
    flat = F.translate(four, "[]", "")
    wh = e("[%d,%d,%d,%d]", "x0", "y0", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    forms = [
        F.concat(F.lit('{"shapes":[{"label":"Porosity","points":'), four, F.lit("}]}")),
        F.concat(F.lit('{"a":{"b":[1,{"class":"defect","coordinate":'), e('{"x":[%d,%d,%d,%d],"y":[%d,%d,%d,%d]}', "x0", "x1", "x1", "x0", "y0", "y0", "y1", "y1"), F.lit(',"case":"기공"}]}}')),
        F.concat(F.lit('{"annotations":[{"category":{"id":1,"name":"Pore"},"segmentation":[['), flat, F.lit("]]}]}")),
        F.concat(F.lit('{"items":[{"class":"defect","polygon":'), e('[{"x":%d,"y":%d},{"x":%d,"y":%d},{"x":%d,"y":%d}]', "x0", "y0", "x1", "y0", "x1", "y1"), F.lit("}]}")),
        F.concat(F.lit('{"Box":'), wh, F.lit("}")),
        F.concat(F.lit('{"n":{"type":"gas-pore","bndbox":'), e('{"xmin":%d,"ymin":%d,"xmax":%d,"ymax":%d}', "x0", "y0", "x1", "y1"), F.lit("}}")),
        e('{"marks":[{"center":[%d,%d],"r":%d}]}', "x0", "y0", (F.col("width") / 80).cast("int")),
        F.concat(F.lit('{"tag":"Normal","bbox":'), wh, F.lit("}")),
        e('{"points":[[%d,%d]]}', "x0", "y0"),
        e('{"coords":[[%d,%d],[%d,%d],[%d,%d]]}', "x0", "y0", "x0", "y0", "x1", "y1"),
        e('{"shape_type":"circle","label":"pore","points":[[%d,%d],[%d,%d]]}', "x0", "y0", (F.col("x0") + F.col("width") / 80).cast("int"), "y0"),
        e('{"shape_type":"rectangle","defect":"blowhole","points":[[%d,%d],[%d,%d]]}', "x0", "y0", "x1", "y1"),
        F.concat(F.lit('{"x":[{"poly":['), flat, F.lit('],"name":"pore"},{"rect":'), e('{"left":%d,"top":%d,"right":%d,"bottom":%d}', "x0", "y0", "x1", "y1"), F.lit("}]}")),
        F.lit('{"empty":[]}'),
    ]
    form = F.coalesce(*(F.when(k % len(forms) == i, f) for i, f in enumerate(forms)))
    return c.select("label_id", "width", "height", form.alias("text"))


V_FILE = """v_catalogue AS (SELECT o_orderkey AS label_id, 'img.' || o_orderkey AS stem, CASE WHEN o_orderkey % 4 < 2 THEN 1280 WHEN o_orderkey % 4 = 2 THEN 5120 ELSE 640 END AS w, CASE WHEN o_orderkey % 4 < 2 THEN 720 WHEN o_orderkey % 4 = 2 THEN 1440 ELSE 480 END AS h, o_orderkey % 4 < 2 AS is_tile,
  o_orderkey % 11 = 0 AS is_crowd, CASE o_orderkey % 3 WHEN 0 THEN 'porosity' WHEN 1 THEN 'normal' ELSE 'crack' END AS cls, CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'val' END AS split, o_orderkey % 17 <> 0 AS image_exists FROM orders),
v_file AS (SELECT *, label_id % 14 AS form, label_id * 37 % 40 + 10 AS x0, label_id * 53 % 20 + 5 AS y0, (label_id % 3 + 1) * 9 AS side FROM v_catalogue WHERE label_id % 13 <> 0),
v_form(form, path, label, outcome, shape) AS (VALUES (0, '$.shapes[0]', 'porosity', 'matched', 'square'), (1, '$.a.b[1]', '기공', 'matched', 'square'), (2, '$.annotations[0]', 'pore', 'matched', 'square'), (3, '$.items[0]', 'defect', 'skipped_label', NULL),
  (4, '$', NULL, 'matched', 'square'), (5, '$.n', 'gas_pore', 'matched', 'square'), (6, '$.marks[0]', NULL, 'matched', 'circle'), (7, '$', 'normal', 'skipped_label', NULL), (8, '$', NULL, 'skipped_geom', NULL), (9, '$', NULL, 'skipped_invalid', NULL),
  (10, '$', 'pore', 'matched', 'circle'), (11, '$', 'blowhole', 'matched', 'square'), (12, '$.x[0]', 'pore', 'matched', 'square'), (12, '$.x[1]', NULL, 'matched', 'square')),
v_node AS (SELECT label_id, w, h, x0, y0, side, path, label, outcome, shape FROM v_file JOIN v_form USING (form))"""


@query(f"""WITH {V_FILE} SELECT label_id, path, label, outcome, CASE shape WHEN 'square' THEN 4 WHEN 'circle' THEN 24 END AS n_points, CASE shape WHEN 'square' THEN round((4 * x0 + 2 * side) / 80.0::DOUBLE, 4) WHEN 'circle' THEN round(24 * x0 / 80.0::DOUBLE, 4) END AS sum_x,
CASE shape WHEN 'square' THEN round((4 * y0 + 2 * side) / 80.0::DOUBLE, 4) WHEN 'circle' THEN round(24 * y0 / 80.0::DOUBLE, 4) END AS sum_y, CASE shape WHEN 'square' THEN round(side * side / 6400.0::DOUBLE, 4) WHEN 'circle' THEN round(12 * sin(pi() / 12) * w / 80.0::DOUBLE / h / 80.0::DOUBLE, 4) END AS area FROM v_node""")
def annotation_nodes(spark, sf):
    p = F.col("points")
    rows = A.extracted(label_files(spark, sf), "width", "height")
    return rows.select("label_id", "path", "label", "outcome", F.size(p).alias("n_points"), F.round(G.total(p, lambda q: q["x"]), 4).alias("sum_x"), F.round(G.total(p, lambda q: q["y"]), 4).alias("sum_y"), F.when(p.isNotNull(), F.round(G.area(p), 4)).alias("area"))


@query(f"""WITH {V_FILE} SELECT w AS width, count(*) AS nodes, {', '.join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in A.OUTCOMES)}, 0::BIGINT AS errors FROM v_node GROUP BY w""")
def annotation_counters(spark, sf):
    return A.counters(A.extracted(label_files(spark, sf), "width", "height"), "width")


V_SPLIT = f"""{V_FILE}, v_pos AS (SELECT split, stem, 1 AS label, 'tile' AS source, label_id, CASE WHEN label_id % 13 = 0 THEN 'pos_missing' WHEN label_id % 14 IN (3, 7, 8, 9, 13) THEN 'pos_no_poly' ELSE 'pos_ok' END AS status, CASE WHEN label_id % 13 = 0 OR label_id % 14 IN (3, 7, 8, 9, 13) THEN 0 WHEN label_id % 14 = 12 THEN 2 ELSE 1 END AS n_poly
  FROM v_catalogue WHERE cls = 'porosity' AND image_exists AND is_tile),
v_wanted AS (SELECT split, (2 * count(*))::BIGINT AS wanted FROM v_pos GROUP BY split),
v_base AS (SELECT *, row_number() OVER (PARTITION BY split, is_tile ORDER BY md5('42:' || label_id), label_id) AS place, count(*) OVER (PARTITION BY split, is_tile) AS n FROM v_catalogue WHERE cls = 'normal' AND image_exists AND (is_tile OR w = 5120)),
v_rest AS (SELECT split, wanted, greatest(0, wanted - (SELECT count(*) FROM v_base b WHERE b.split = q.split AND is_tile)) AS rest, (SELECT count(*) FROM v_base b WHERE b.split = q.split AND NOT is_tile) AS pool FROM v_wanted q),
v_pano AS (SELECT *, least(pool, (rest + 1) // 2) AS panos FROM v_rest),
v_neg AS (SELECT b.split, stem, 0 AS label, 'tile' AS source, label_id, 'neg_tile' AS status, 0 AS n_poly FROM v_base b JOIN v_wanted q ON q.split = b.split WHERE is_tile AND place <= wanted
  UNION ALL SELECT b.split, stem || '_crop' || i, 0, 'crop', label_id, 'neg_crop', 0 FROM v_base b JOIN v_pano p ON p.split = b.split, range(0, 100) r(i) WHERE NOT is_tile AND place <= panos AND i < rest // panos + CASE WHEN place <= rest % panos THEN 1 ELSE 0 END),
v_set AS (SELECT * FROM v_pos UNION ALL SELECT * FROM v_neg)"""


def built(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return D.build_all(catalogue(spark, sf), label_files(spark, sf), ratio=2.0)


@query(f"""WITH {V_SPLIT} SELECT s.split, s.stem, s.label, s.source, s.label_id, n_poly, CASE WHEN n_poly = 1 AND label_id % 14 NOT IN (6, 10) THEN concat_ws(' ', '0', printf('%.6f', x0 / 80.0::DOUBLE), printf('%.6f', y0 / 80.0::DOUBLE), printf('%.6f', (x0 + side) / 80.0::DOUBLE), printf('%.6f', y0 / 80.0::DOUBLE), printf('%.6f', (x0 + side) / 80.0::DOUBLE),
printf('%.6f', (y0 + side) / 80.0::DOUBLE), printf('%.6f', x0 / 80.0::DOUBLE), printf('%.6f', (y0 + side) / 80.0::DOUBLE)) || chr(10) WHEN n_poly = 0 THEN '' END AS label_text FROM v_set s LEFT JOIN v_file USING (label_id) WHERE status IN ('pos_ok', 'neg_tile', 'neg_crop')""")
def split_manifest(spark, sf):
    """The images of both splits; crops without their origins, which SQL cannot draw, and label files of one square."""
    rows = built(spark, sf)[0]
    stem = F.when(F.col("source") == "crop", F.regexp_replace("stem", r"_\d+_\d+$", "")).otherwise(F.col("stem"))
    return rows.withColumns({"stem": stem, "label_text": F.when(F.length("label_text") < 100, F.col("label_text"))})


@query(f"""WITH {V_SPLIT} SELECT split, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in D.STATUSES)}, sum(n_poly)::BIGINT AS total_polygons, count(*) FILTER (status IN ('pos_ok', 'neg_tile', 'neg_crop')) AS n_images FROM v_set GROUP BY split""")
def split_counters(spark, sf):
    return built(spark, sf)[1]


@query()
def crop_origins(spark, sf):
    """Two crops of every panorama; the generator is Python's, tests hold it against the library."""
    rows = catalogue(spark, sf).where("not is_tile and croppable").withColumn("crops", F.lit(2))
    return D.crop_origins(rows.select("label_id", "width", "height", "crops")).select("label_id", "k", "x0", "y0")


@query(f"WITH {V_FILE} SELECT verdict, count(*) AS n, sum(label_id)::BIGINT AS ids, count(*) FILTER (NOT is_tile) AS other_sizes FROM (SELECT *, CASE WHEN cls = 'porosity' AND NOT is_crowd THEN 'abnormal' WHEN cls = 'normal' AND is_tile THEN 'normal' END AS verdict FROM v_catalogue WHERE image_exists) WHERE verdict IS NOT NULL GROUP BY verdict")
def case_images(spark, sf):
    return D.case_rows(catalogue(spark, sf)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("label_id").alias("ids"), F.count_if(~F.col("is_tile")).alias("other_sizes"))


@query(f"""WITH {V_FILE}, v_image AS (SELECT *, CASE WHEN cls = 'porosity' AND NOT is_crowd THEN 'abnormal' WHEN cls = 'normal' AND is_tile THEN 'normal' END AS verdict FROM v_catalogue WHERE image_exists),
v_found AS (SELECT label_id, n.w, n.h, shape, count(*)::INT AS n, any_value(CASE shape WHEN 'square' THEN 2 * sqrt(side * side / 6400.0::DOUBLE * n.w * n.h / pi()) ELSE 2 * sqrt(12 * sin(pi() / 12) * n.w / 80 * n.w / 80 / pi()) END) AS d FROM v_node n JOIN v_image USING (label_id) WHERE verdict = 'abnormal' AND outcome = 'matched' GROUP BY ALL)
SELECT label_id AS image, 'abnormal' AS verdict, CASE WHEN n = 1 THEN '단독' ELSE '군집' END AS distribution, n AS n_instances, CASE WHEN shape = 'square' AND w = 5120 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS elongated, round(d, 1) AS mean_d, 'img.' || label_id AS stem FROM v_found
UNION ALL SELECT label_id, 'normal', '해당없음', 0, 0.0::DOUBLE, 0.0::DOUBLE, 'img.' || label_id FROM v_image WHERE verdict = 'normal'""")
def case_table(spark, sf):
    """The case table built, stored, read back, and through its JSON form."""
    profiles, settings = stored_cases(spark, sf)
    back = profiles.select(T.from_json(T.to_json()).alias("p")).select("p.*")
    return back.select("image", "verdict", "distribution", "n_instances", "elongated", F.round("mean_d", 1).alias("mean_d"), F.col("meta")["stem"].alias("stem"))


def stored_cases(spark, sf):
    images = D.case_rows(catalogue(spark, sf).withColumn("image_path", F.concat(F.lit("images/"), "filename")))
    path = f"{work_folder(spark)}/seamline-cases-{uuid.uuid4().hex}"
    T.save(*T.built(images, label_files(spark, sf)), path, 1)
    return T.load(spark, path)


@query()
def stored_case_search(spark, sf):
    """Images of the stored table whose id is divisible by 100, against all of it; tests hold
    the search against the ranking of all pairs."""
    profiles, _ = stored_cases(spark, sf)
    top = S.nearest(profiles.where("image % 100 = 0").drop("verdict"), profiles, 5)
    return top.select("query_id", "case_id", "rank", "verdict", F.round("score", 6).alias("score"))
