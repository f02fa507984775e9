"""Queries: label files to a catalogue with its errors, payload and history as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators import history as H
from seamline.operators import payload as P
from seamline.plans.proxies import V_CASE, cases, table
from seamline.sources import files as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


CLASSES = ("정상", "균열", "기공", "융합불량", "슬래그혼입", "용입부족", "언더컷", "기타")


def label_files(spark: SparkSession, sf: str) -> DataFrame:
    """A label file per order: its lines are annotations, right-angled with a longest side of
    2.5 times their quantity; some files are broken or lack parts."""
    a = F.format_string('{"class":"%s","coordinate":{"x":[0,%s,%s],"y":[0,0,%s]}}', F.when(F.col("l_linenumber") % 4 == 0, "normal").otherwise("defect"), (F.col("l_quantity") * 1.5).cast("string"), (F.col("l_quantity") * 1.5).cast("string"), (F.col("l_quantity") * 2).cast("string"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", a.alias("a")))).alias("of"))
    k = F.col("k")
    every = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).join(lines, "k", "left")
    cls = F.get(F.array(*map(F.lit, CLASSES)), (k % 9).cast("int"))
    info = F.format_string('{"info":{"id":%d,"type":"%s","material":"SS"},', k, F.when(k % 3 == 0, "RT-1").when(k % 3 == 1, "vt x").otherwise("UT"))
    image = F.concat(F.format_string('"image_data":{"file_name":"img.%d","format":"jpg","width":1280,"height":720', k), F.coalesce(F.concat(F.lit(',"information":"'), cls, F.lit('"')), F.lit("")), F.lit("}"))
    found = F.coalesce(F.array_join(F.transform("of", lambda x: x["a"]), ","), F.lit(""))
    meta = F.concat(F.format_string(',"meta":{"is_crowd":%d,"annotation_case":["a","b"]},"annotations":[', (k % 2)), found, F.lit("]}"))
    text = F.when(k % 19 == 0, '{"info":').when(k % 19 == 1, F.concat(info, F.lit('"meta":{}}'))).otherwise(F.concat(info, image, meta))
    return every.select(F.concat(F.lit("x/labels/"), k, F.lit(".json")).alias("path"), text.alias("text"))


def images(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").where(k % 17 != 0).select(F.concat(F.lit("img."), k, F.lit(".jpg")).alias("file_name"))


NAMES = ", ".join(f"'{c}'" for c in CLASSES)
V_FILE = f"""v_line AS (SELECT l_orderkey AS k, count(*)::INT AS n, list(round_even((2.5 * l_quantity)::DOUBLE, 0)::INT ORDER BY l_linenumber, l_partkey, l_quantity) FILTER (l_linenumber % 4 <> 0) AS sizes FROM lineitem GROUP BY 1),
v_file AS (SELECT o_orderkey AS k, coalesce(n, 0) AS n, coalesce(sizes, []) AS sizes, ([{NAMES}])[(o_orderkey % 9 + 1)::INT] AS cls, CASE o_orderkey % 3 WHEN 0 THEN 'RT-1' WHEN 1 THEN 'vt x' ELSE 'UT' END AS type
FROM orders LEFT JOIN v_line ON k = o_orderkey WHERE o_orderkey % 19 > 1)"""


@query(f"""WITH {V_FILE} SELECT k AS label_id, 'img.' || k || '.jpg' AS filename, 'images/train/img.' || k || '.jpg' AS image_path, 'labels/train/' || k || '.json' AS label_path, type, 'SS' AS material, cls AS class, 1280 AS width, 720 AS height,
(k % 2)::INT AS is_crowd, 'a,b' AS annotation_case, n AS num_annotations, 'train' AS split, k % 17 <> 0 AS image_exists FROM v_file""")
def label_catalogue(spark, sf):
    return S.catalogued(label_files(spark, sf), images(spark, sf), "train")[0]


@query("""SELECT 'labels/train/' || o_orderkey || '.json' AS label_path, CASE o_orderkey % 19 WHEN 0 THEN 'no JSON' WHEN 1 THEN 'without image_data, file_name, format' ELSE 'no image img.' || o_orderkey || '.jpg' END AS reason
FROM orders WHERE o_orderkey % 19 < 2 OR o_orderkey % 17 = 0""")
def label_errors(spark, sf):
    return S.catalogued(label_files(spark, sf), images(spark, sf), "train")[1]


CODE = "CASE cls WHEN '기공' THEN 1 WHEN '슬래그혼입' THEN 2 WHEN '융합불량' THEN 3 WHEN '균열' THEN 4 WHEN '용입부족' THEN 5 WHEN '언더컷' THEN 6 ELSE 0 END"
HEAD = """'{"source":"labels","n_images_total":' || count(*) || ',"n_defects_total":' || sum(len(sizes)) || ',"sample_rate":0.5,"n_sample":' || count(*) || ',"type_codes":{"RT":0,"VT":1},"class_codes":{"none":0,"porosity":1,"slag":2,"lof":3,"crack":4,"lp":5,"undercut":6},"rows":['"""


@query(f"""WITH {V_FILE}, s AS (SELECT *, row_number() OVER (ORDER BY 'x/labels/' || k || '.json') AS place FROM v_file WHERE ('0x' || substr(md5('42:x/labels/' || k || '.json'), 1, 8))::BIGINT < 2147483648)
SELECT place, CASE WHEN place > 1 THEN ',' ELSE '' END || '[' || array_to_string(list_concat([CASE WHEN type = 'vt x' THEN 1 ELSE 0 END, {CODE}], sizes), ',') || ']' AS value FROM s
UNION ALL SELECT 0, {HEAD} FROM s UNION ALL SELECT count(*) + 1, ']}}' FROM s""")
def label_payload(spark, sf):
    """The payload of half of the label files, as the lines of one document."""
    return P.payload(S.parsed_labels(P.sampled(label_files(spark, sf), 0.5))[0], "labels", 0.5)


MANAGED = "day BETWEEN 10 AND 60 AND cls IN ('1-URGENT', '2-HIGH')"


@query(f"WITH {V_CASE} SELECT part, count(*) AS n, count(*) FILTER (human = rule) AS agreed, count(reason) AS escalated FROM v_case WHERE {MANAGED} GROUP BY part")
def managed_parts(spark, sf):
    shown = H.managed(cases(spark, sf), (10, 60), cls=["1-URGENT", "2-HIGH"], inspector=None)
    return shown.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("human") == F.col("rule")).alias("agreed"), F.count("reason").alias("escalated"))


ROW = """'{"m":' || margin::DECIMAL(12,4) || ',"g":' || grade || ',"r":' || rule || ',"h":' || human || ',"p":"' || part || '","d":' || day || CASE WHEN reason IS NULL THEN '' ELSE ',"w":"' || reason || '"' END || ',"sv":' || coalesce(senior, -1) || '}'"""


@query(f"""WITH {V_CASE}, q AS (SELECT *, row_number() OVER (ORDER BY day, image) AS place, count(*) OVER () AS n FROM v_case WHERE reason IS NOT NULL AND day >= 86), c AS (SELECT *, row_number() OVER (ORDER BY image) AS place FROM v_case),
t AS (SELECT count(*) AS n FROM v_case), m AS (SELECT count(*) AS n FROM q)
SELECT 0 AS place, '{{"meta":{{"n":' || n || '}},"queue":[' AS value FROM t UNION ALL SELECT place, CASE WHEN place > 1 THEN ',' ELSE '' END || image AS value FROM q
UNION ALL SELECT n + 1, '],"cases":[' FROM m UNION ALL SELECT m.n + 1 + place, CASE WHEN place > 1 THEN ',' ELSE '' END || {ROW} FROM c, m UNION ALL SELECT m.n + t.n + 2, ']}}' FROM m, t""")
def history_document(spark, sf):
    """The history with its open cases as the lines of one JSON document."""
    from seamline.sources.tables import kept

    h = kept(cases(spark, sf), "history")
    row = F.to_json(F.struct(F.col("margin").cast("decimal(12,4)").alias("m"), F.col("grade").alias("g"), F.col("rule").alias("r"), F.col("human").alias("h"), F.col("part").alias("p"), F.col("day").alias("d"), F.col("reason").alias("w"), F.coalesce("senior", F.lit(-1)).alias("sv")))
    waiting = h.where("reason is not null and day >= 86").select("day", "image", F.col("image").cast("string").alias("json"))
    return P.document({"meta": {"n": h.count()}}, {"queue": waiting, "cases": h.select("image", row.alias("json"))})
