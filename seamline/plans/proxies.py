"""Inspection views over the test tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions import acceptance as A
from seamline.operators import history as H
from seamline.operators import judgement as J


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, line, d (mm) of each defect, t (mm) of its image, and the part's key and type."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("line"), "l_partkey", (F.col("l_quantity") * 0.2).alias("d"))
    rows = rows.join(part, rows.l_partkey == part.p_partkey)
    from pyspark.sql import Window as W

    return rows.select("image", "line", "l_partkey", "p_type", "d", F.max("p_size").over(W.partitionBy("image")).cast("double").alias("t"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict history: one judged image per order with lines."""
    rows = defects(spark, sf_dir)
    part = rows.groupBy("image").agg(F.max_by("p_type", "l_partkey").alias("part"))
    judged = J.porosity_margin(rows).join(part, "image")
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    o = orders.select(
        key.alias("image"), F.col("o_custkey"), F.col("o_orderpriority").alias("cls"),
        (F.pmod(F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")), F.lit(90))).cast("int").alias("day"),
        ((key * 37 % 100) / 100.0).alias("sim"), ((key * 53 % 100) / 100.0).alias("conf"),
        (key % 50 != 0).alias("supported"), (key % 40 != 0).alias("scaled"), (key % 60 != 0).alias("complete"),
    )
    out = judged.join(o, "image").withColumns({"rule": (F.col("raw") > 1).cast("int"), "grade": A.grade(F.col("margin")), "inspector": (F.col("o_custkey") % 13).cast("int"), "seconds": F.col("o_custkey") % 300 + 60})
    out = out.withColumn("human", (F.col("margin") > 0.8 + 0.4 * (F.col("o_custkey") % 2)).cast("int"))
    c = F.col
    out = out.withColumn("reason", H.escalation(c("human"), c("rule"), c("cls") != "5-LOW", c("conf"), c("supported"), c("scaled"), c("grade"), c("sim"), c("complete"), c("margin")))
    return out.withColumn("senior", F.when(c("reason").isNotNull() & (c("image") % 3 == 0), (c("image") % 2).cast("int")))


POINTS = "CASE WHEN {0} <= 1 THEN 1 WHEN {0} <= 2 THEN 2 WHEN {0} <= 3 THEN 3 WHEN {0} <= 4 THEN 6 WHEN {0} <= 6 THEN 10 WHEN {0} <= 8 THEN 15 ELSE 25 END"
POINT_LIMIT = "CASE WHEN t <= 10 THEN 6 WHEN t <= 25 THEN 12 WHEN t <= 50 THEN 24 ELSE 30 END"
SIZE_LIMIT = "CASE WHEN t <= 10 THEN 4.0::DOUBLE WHEN t <= 25 THEN 5.0::DOUBLE WHEN t <= 50 THEN t / 5.0::DOUBLE ELSE 10.0::DOUBLE END"
LENGTH_LIMIT = "CASE WHEN t <= 12 THEN 6.0::DOUBLE WHEN t <= 50 THEN t / 2.0::DOUBLE ELSE 24.0::DOUBLE END"
IGNORED = "CASE WHEN t <= 25 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END"
GRADE = "CASE WHEN {0} <= 0.5 THEN 1 WHEN {0} <= 1 THEN 2 WHEN {0} <= 2 THEN 3 ELSE 4 END"


def margin_sql(source: str, by: str = "image, t", d: str = "d") -> str:
    """DuckDB: n, points, max_d and margin of each group of defects."""
    p = POINTS.format(d)
    return f"""SELECT *, round(raw, 4) AS margin FROM (SELECT *, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE greatest(points / ({POINT_LIMIT})::DOUBLE, max_d / ({SIZE_LIMIT})) END AS raw FROM (
SELECT {by}, count(*) FILTER ({d} > {IGNORED}) AS n, coalesce(sum({p}) FILTER ({d} > {IGNORED}), 0)::BIGINT AS points, coalesce(max({d}) FILTER ({d} > {IGNORED}), 0.0::DOUBLE) AS max_d FROM {source} GROUP BY {by}))"""


V_DEFECT = "v_defect AS (SELECT l_orderkey AS image, l_linenumber AS line, l_partkey, p_type, l_quantity * 0.2::DOUBLE AS d, (max(p_size) OVER (PARTITION BY l_orderkey))::DOUBLE AS t FROM lineitem JOIN part ON l_partkey = p_partkey)"
V_CASE = f"""{V_DEFECT},
v_margin AS ({margin_sql('v_defect')}),
v_part AS (SELECT image, max_by(p_type, l_partkey) AS part FROM v_defect GROUP BY image),
v_order AS (SELECT o_orderkey AS image, o_custkey, o_orderpriority AS cls, (date_diff('day', DATE '1995-01-01', o_orderdate::DATE) % 90)::INT AS day, (o_orderkey * 37 % 100) / 100.0::DOUBLE AS sim,
  (o_orderkey * 53 % 100) / 100.0::DOUBLE AS conf, o_orderkey % 50 <> 0 AS supported, o_orderkey % 40 <> 0 AS scaled, o_orderkey % 60 <> 0 AS complete FROM orders),
v_judged AS (SELECT *, (raw > 1)::INT AS rule, {GRADE.format('margin')} AS grade, (o_custkey % 13)::INT AS inspector, o_custkey % 300 + 60 AS seconds, (margin > 0.8::DOUBLE + 0.4::DOUBLE * (o_custkey % 2))::INT AS human
  FROM v_margin JOIN v_part USING (image) JOIN v_order USING (image)),
v_reason AS (SELECT *, CASE WHEN human <> rule THEN 'mismatch' WHEN cls <> '5-LOW' AND conf < 0.5 THEN 'low_confidence' WHEN NOT supported THEN 'unsupported' WHEN NOT scaled THEN 'scale_unknown' WHEN rule = 1 OR grade = 4 THEN 'rule_reject'
  WHEN sim < 0.46 THEN 'few_similar' WHEN NOT complete THEN 'input_missing' WHEN margin BETWEEN 0.85 AND 1.18 THEN 'grey_zone' END AS reason FROM v_judged),
v_case AS (SELECT *, CASE WHEN reason IS NOT NULL AND image % 3 = 0 THEN (image % 2)::INT END AS senior FROM v_reason)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem, label, source and confidences of labelled documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    lab = table(spark, sf_dir, "labels").where("quality is not null").select(F.col("doc_id").alias("stem"), F.col("quality").alias("label"))
    k = F.col("stem")
    conf = lambda a, b: ((k * a + b + F.col("label") * 20) % 100) / 100.0
    rows = lab.join(d, k == F.col("doc_id")).select("stem", "label", "source", F.when(k % 7 == 0, F.array().cast("array<double>")).when(k % 2 == 0, F.array(conf(37, 11), conf(53, 5))).otherwise(F.array(conf(37, 11))).alias("confs"))
    return rows.withColumn("score", F.coalesce(F.array_max("confs"), F.lit(0.0)))


V_SCORES = """v_scores AS (SELECT *, coalesce(list_max(confs), 0.0::DOUBLE) AS score FROM (SELECT l.doc_id AS stem, quality AS label, source,
  CASE WHEN l.doc_id % 7 = 0 THEN []::DOUBLE[] WHEN l.doc_id % 2 = 0 THEN [((l.doc_id * 37 + 11 + quality * 20) % 100) / 100.0::DOUBLE, ((l.doc_id * 53 + 5 + quality * 20) % 100) / 100.0::DOUBLE]
  ELSE [((l.doc_id * 37 + 11 + quality * 20) % 100) / 100.0::DOUBLE] END AS confs FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality IS NOT NULL))"""
