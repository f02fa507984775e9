"""Queries: detected instances, signals, regulation sources, further key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions import geometry as G
from seamline.functions import signals
from seamline.operators import chunking as C
from seamline.operators import history as H
from seamline.operators import instances as I
from seamline.operators import regulation as R
from seamline.plans.proxies import V_CASE, cases, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """Ten detections an image of 1280 x 720; each fifth one without a mask."""
    k = F.col("vec_id")
    points = G.scaled(F.transform(G.from_flat(F.col("embedding")), lambda p: F.struct((p["x"] + 0.5).alias("x"), (p["y"] + 0.5).alias("y"))), F.lit(1280), F.lit(720))
    low = (k % 700).cast("double")
    return table(spark, sf, "embeddings").select(
        F.floor(k / 10).alias("image"), (k % 10).alias("no"), (k * 37 % 100 / 100.0).alias("conf"), F.array(low, low / 2, low + k % 90, low / 2 + k % 40).alias("box"),
        F.when(k % 5 != 0, points).alias("polygon"), F.lit(1280).alias("w"), F.lit(720).alias("h"), F.when(k % 3 != 0, F.lit(0.1)).alias("spacing"),
    )


V_RAW = """v_point AS (SELECT vec_id, i, (embedding[2 * i + 1]::DOUBLE + 0.5) * 1280 AS x, (embedding[2 * i + 2]::DOUBLE + 0.5) * 720 AS y FROM embeddings, range(0, 32) r(i)),
v_mask AS (SELECT a.vec_id, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS area, avg(a.x) AS cx, avg(a.y) AS cy, sum(round(a.x, 2)) AS px, sum(round(a.y, 2)) AS py FROM v_point a JOIN v_point b ON a.vec_id = b.vec_id AND b.i = (a.i + 1) % 32 GROUP BY a.vec_id),
v_raw AS (SELECT vec_id // 10 AS image, vec_id % 10 AS no, vec_id * 37 % 100 / 100.0::DOUBLE AS conf, CASE WHEN vec_id % 5 = 0 THEN 'box' ELSE 'mask' END AS origin,
  CASE WHEN vec_id % 5 = 0 THEN ((vec_id % 90) * (vec_id % 40))::DOUBLE ELSE area END AS area, CASE WHEN vec_id % 5 = 0 THEN vec_id % 700 + (vec_id % 90) / 2.0::DOUBLE ELSE cx END AS cx,
  CASE WHEN vec_id % 5 = 0 THEN (vec_id % 700) / 2.0::DOUBLE + (vec_id % 40) / 2.0::DOUBLE ELSE cy END AS cy, CASE WHEN vec_id % 3 <> 0 THEN 0.1::DOUBLE END AS spacing, (vec_id % 700)::DOUBLE AS x1, (vec_id % 700) / 2.0::DOUBLE AS y1, (vec_id % 700 + vec_id % 90)::DOUBLE AS x2, (vec_id % 700) / 2.0::DOUBLE + vec_id % 40 AS y2,
  CASE WHEN vec_id % 5 = 0 THEN 4 ELSE 32 END AS np, CASE WHEN vec_id % 5 = 0 THEN 4.0::DOUBLE * (vec_id % 700) + 2 * (vec_id % 90) ELSE px END AS px, CASE WHEN vec_id % 5 = 0 THEN 2.0::DOUBLE * (vec_id % 700) + 2 * (vec_id % 40) ELSE py END AS py FROM v_mask),
v_inst AS (SELECT image, row_number() OVER (PARTITION BY image ORDER BY no) - 1 AS id, conf, origin, round(area, 2) AS area_px, round(area / (1280 * 720), 8) AS area_ratio,
  round(2 * sqrt(area / pi()), 3) AS diameter_px, round(2 * sqrt(area / pi()) * spacing, 4) AS diameter_mm, round(cx, 2) AS cx, round(cy, 2) AS cy, [x1, y1, x2, y2] AS box, np AS n_points, round(px, 2) AS sum_x, round(py, 2) AS sum_y FROM v_raw WHERE conf >= 0.25)"""


@query(f"WITH {V_RAW} SELECT * FROM v_inst")
def instance_table(spark, sf):
    return drawn(I.instance_table(raw(spark, sf))).drop("polygon", "w", "h")


def drawn(rows: DataFrame) -> DataFrame:
    """Polygons as their number of points and sums of coordinates."""
    total = lambda c: F.round(G.total(F.col("polygon"), lambda p: p[c]), 2)
    return rows.withColumns({"n_points": F.size("polygon"), "sum_x": total("x"), "sum_y": total("y")})


@query(f"""WITH {V_RAW}, n AS (SELECT image, count(*) AS n, sum(area_px) AS total FROM v_inst GROUP BY image), b AS (SELECT image, max(conf) AS score FROM v_raw GROUP BY image)
SELECT p_partkey AS image, CASE WHEN coalesce(n, 0) >= 5 THEN 'abnormal' ELSE 'normal' END AS verdict, coalesce(score, 0.0::DOUBLE) AS score, coalesce(n, 0) AS n_instances, round(coalesce(total, 0.0::DOUBLE), 2) AS total_area, round(coalesce(total, 0.0::DOUBLE) / (1280 * 720), 8) AS total_ratio
FROM part LEFT JOIN b ON image = p_partkey LEFT JOIN n ON n.image = p_partkey""")
def image_verdicts(spark, sf):
    images = table(spark, sf, "part").select(F.col("p_partkey").alias("image"), F.lit(1280).alias("w"), F.lit(720).alias("h"))
    return I.image_verdicts(raw(spark, sf), images, min_instances=5)


@query(f"""WITH {V_RAW}, t AS (SELECT image // 4 AS image, (image % 2) * 640 AS x0, (image // 2 % 2) * 360 AS y0, id, conf, area_px, cx, cy, box, n_points, sum_x, sum_y FROM v_inst)
SELECT image, x0, y0, [box[1] + x0, box[2] + y0, box[3] + x0, box[4] + y0] AS box, n_points, round(sum_x + n_points * x0, 2) AS sum_x, round(sum_y + n_points * y0, 2) AS sum_y, row_number() OVER (PARTITION BY image ORDER BY y0, x0, id) - 1 AS id, area_px, round(cx + x0, 2) AS cx, round(cy + y0, 2) AS cy, round(area_px / (1920 * 1080), 10) AS area_ratio FROM t""")
def merged_tiles(spark, sf):
    k = F.col("image")
    found = I.instance_table(raw(spark, sf)).withColumns({"x0": (k % 2) * 640, "y0": (F.floor(k / 2) % 2) * 360, "image": F.floor(k / 4)})
    images = found.select("image").distinct().withColumns({"w": F.lit(1920), "h": F.lit(1080)})
    return drawn(I.merged_tiles(found, images)).select("image", "x0", "y0", "box", "n_points", "sum_x", "sum_y", "id", "area_px", F.round("cx", 2).alias("cx"), F.round("cy", 2).alias("cy"), "area_ratio")


@query(f"""WITH {V_RAW}, t AS (SELECT image // 4 AS image, count(*) AS n, sum(area_px) AS total, max(conf) AS score FROM v_inst GROUP BY ALL)
SELECT p_partkey AS image, CASE WHEN coalesce(n, 0) >= 20 THEN 'abnormal' ELSE 'normal' END AS verdict, round(coalesce(score, 0.0::DOUBLE), 6) AS score, coalesce(n, 0) AS n_instances, round(coalesce(total, 0.0::DOUBLE), 2) AS total_area, round(coalesce(total, 0.0::DOUBLE) / (1920 * 1080), 10) AS total_ratio FROM part LEFT JOIN t ON image = p_partkey""")
def merged_tile_verdicts(spark, sf):
    k = F.col("image")
    found = I.instance_table(raw(spark, sf)).withColumns({"x0": (k % 2) * 640, "y0": (F.floor(k / 2) % 2) * 360, "image": F.floor(k / 4)})
    images = table(spark, sf, "part").select(F.col("p_partkey").alias("image"), F.lit(1920).alias("w"), F.lit(1080).alias("h"))
    return I.merged_verdicts(I.merged_tiles(found, images), images, min_instances=20)


@query("""WITH v AS (SELECT vec_id, [x::DOUBLE * 100 for x in embedding] AS v FROM embeddings), m AS (SELECT *, list_min(v) AS low, list_min(v) + greatest(list_max(v) - list_min(v), 1.0::DOUBLE) / 2 AS half FROM v),
a AS (SELECT *, list_position(v, low) - 1 AS dip FROM m)
SELECT vec_id, round((coalesce(list_min([i for i in range(dip, len(v)) if v[i + 1] >= half]), len(v) - 1) - coalesce(list_max([i for i in range(0, dip + 1) if v[i + 1] >= half]), 0)) / (len(v) - 1)::DOUBLE * 2.5::DOUBLE, 6) AS width FROM a""")
def profile_width(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double") * 100)
    return table(spark, sf, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(signals.half_width(F.col("v"), F.lit(2.5)), 6).alias("width"))


@query("SELECT vec_id, round(list_sum([0.299::DOUBLE * embedding[i] + 0.587::DOUBLE * embedding[i + 1] + 0.114::DOUBLE * embedding[i + 2] for i in range(1, 61)]), 4) AS bright FROM embeddings")
def profile_brightness(spark, sf):
    part = lambda k: F.transform(F.slice("embedding", k, 60), lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(signals.luma(part(1), part(2), part(3)), F.lit(0.0), lambda a, x: a + x), 4).alias("bright"))


@query("SELECT p_partkey, least(greatest((p_partkey % 1100) / 10.0::DOUBLE, 2.0::DOUBLE), 98.0::DOUBLE) AS place, CASE p_partkey % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'amber' WHEN 2 THEN 'red' END AS colour FROM part")
def decision_markers(spark, sf):
    k = F.col("p_partkey")
    decision = F.when(k % 4 == 0, "승인").when(k % 4 == 1, "재검사").when(k % 4 == 2, "보수").otherwise("")
    return table(spark, sf, "part").select("p_partkey", signals.marker(k % 1100 / 10.0).alias("place"), signals.colour(decision).alias("colour"))


def registry(spark, sf):
    """A source per nation: some skipped, some restricted, some with an id for guidance."""
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        k.alias("source"), (k % 7 == 0).alias("skip"), F.when(k % 3 == 0, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).alias("chapters"), F.when(k % 5 == 0, F.array(F.lit("rule"))).otherwise(F.array().cast("array<string>")).alias("doc_types"),
        F.when(k % 2 == 0, F.concat(F.lit("g"), k)).alias("guidance_doc_id"), F.transform(F.sequence(F.lit(11), 11 + k % 4), lambda i: F.concat(F.lit("표"), i)).alias("tables"),
    )


@query("""SELECT c_custkey, c_nationkey AS source, CASE WHEN c_custkey % 4 = 0 AND c_nationkey % 2 = 0 THEN 'g' || c_nationkey ELSE 'r' || c_nationkey END AS doc_id, c_mktsegment AS chapter, CASE WHEN c_custkey % 4 = 0 THEN 'guidance' ELSE 'rule' END AS doc_type
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey % 7 <> 0 AND (c_nationkey % 3 <> 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY')) AND (c_nationkey % 5 <> 0 OR c_custkey % 4 <> 0)""")
def selected_nodes(spark, sf):
    k = F.col("c_custkey")
    nodes = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("source"), F.concat(F.lit("r"), "c_nationkey").alias("doc_id"), F.col("c_mktsegment").alias("chapter"), F.when(k % 4 == 0, "guidance").otherwise("rule").alias("doc_type"))
    return R.selected_nodes(nodes, registry(spark, sf))


@query("SELECT n_nationkey AS source, '표' || i AS table_id FROM nation, range(11, 15) r(i) WHERE i <= 11 + n_nationkey % 4 AND i <> 12")
def exported_tables(spark, sf):
    return R.exported_tables(R.source_tables(registry(spark, sf)))


@query("SELECT doc_id, i::INT AS page, length(string_split(text, '. ')[i]) AS chars FROM documents, range(1, 1 + len(string_split(text, '. '))) r(i)")
def form_feed_pages(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("\f")).alias("text"))
    return R.pages(docs).select("doc_id", "page", F.length("text").cast("long").alias("chars"))


@query("""WITH c AS (SELECT source, lang, doc_id, unnest(string_split(text, '. ')) AS chunk, generate_subscripts(string_split(text, '. '), 1) - 1 AS no FROM documents),
o AS (SELECT DISTINCT substr(sha1(concat_ws('|', source, lang, doc_id::VARCHAR, no::VARCHAR, substr(chunk, 1, 64))), 1, 16) AS chunk_id FROM c), n AS (SELECT DISTINCT substr(sha1(concat_ws('|', source, lang, doc_id::VARCHAR, no::VARCHAR, substr(CASE WHEN doc_id % 10 = 0 AND no % 3 = 1 THEN '+' || chunk ELSE chunk END, 1, 64))), 1, 16) AS chunk_id FROM c WHERE doc_id % 25 <> 0 OR no > 0)
SELECT chunk_id, 'removed' AS change FROM o ANTI JOIN n USING (chunk_id) UNION ALL SELECT chunk_id, 'added' FROM n ANTI JOIN o USING (chunk_id)""")
def edition_changes(spark, sf):
    """Chunk ids of two editions: in the new one some chunks are changed and some first ones left out."""
    rows = table(spark, sf, "documents").select("source", "lang", F.col("doc_id"), F.posexplode(F.split("text", r"\. ")).alias("no", "chunk"))
    ids = lambda df: df.select(C.chunk_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string"), F.col("no"), F.col("chunk")).alias("chunk_id"))
    changed = (F.col("doc_id") % 10 == 0) & (F.col("no") % 3 == 1)
    new = rows.where("doc_id % 25 <> 0 or no > 0").withColumn("chunk", F.when(changed, F.concat(F.lit("+"), "chunk")).otherwise(F.col("chunk")))
    return R.edition_changes(ids(rows), ids(new))


@query(r"SELECT doc_id, contains(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN upper(text) ELSE text END, '\s', '', 'g'), left(regexp_replace(substring(text, 1, 30), '\s', '', 'g'), 15)) AS found FROM documents WHERE text IS NOT NULL")
def page_probe(spark, sf):
    chunk, page = F.concat(F.lit("head\n"), "text"), F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", R.on_page(chunk, page).alias("found"))


@query("SELECT lang, source, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY lang, source")
def article_counts(spark, sf):
    return R.article_counts(table(spark, sf, "documents"), "lang", "source", order="doc_id")


@query("""WITH c AS (SELECT s_suppkey AS clause, ['t' || s_suppkey % 5, 'u' || s_suppkey % 3] AS topics FROM supplier), w AS (SELECT 'a' AS cls, ['t0', 't1'] AS wanted UNION ALL SELECT 'b', ['u2'] UNION ALL SELECT 'none', ['v']),
h AS (SELECT cls, clause, list_has_any(topics, wanted) AS hit FROM c, w), f AS (SELECT *, bool_or(hit) OVER (PARTITION BY cls) AS known FROM h)
SELECT cls, clause, place, round(pow(place, -0.75), 6) AS weight FROM (SELECT cls, clause, row_number() OVER (PARTITION BY cls ORDER BY clause)::INT AS place FROM f WHERE hit OR NOT known)""")
def citation_candidates(spark, sf):
    k = F.col("s_suppkey")
    clauses = table(spark, sf, "supplier").select(k.alias("clause"), F.array(F.concat(F.lit("t"), k % 5), F.concat(F.lit("u"), k % 3)).alias("topics"))
    return R.candidates(clauses, {"a": ("t0", "t1"), "b": ("u2",), "none": ("v",)})


def reviewed(spark, sf):
    """Cases with report outcome and time, AI share, crop, false alarm and clause."""
    k = F.col("image")
    return cases(spark, sf).withColumns({"report": (k * 31 % 5).cast("int"), "report_seconds": k * 7 % 240 + 30, "ai": k % 3 == 0, "cropped": k % 4 == 0, "false_alarm": k % 45 == 0, "clause": k % 177, "level": F.concat(F.lit("L"), F.col("inspector") % 3)})


V_REVIEWED = f"{V_CASE}, v_rev AS (SELECT *, (image * 31 % 5)::INT AS report, image * 7 % 240 + 30 AS report_seconds, image % 3 = 0 AS ai, image % 4 = 0 AS cropped, image % 45 = 0 AS false_alarm, image % 177 AS clause, 'L' || inspector % 3 AS level FROM v_case)"


@query(f"""WITH {V_REVIEWED} SELECT count(*) AS cases, round(avg((human = rule)::INT), 4) AS agreement, round(avg((human <> rule)::INT), 4) AS disagreement, round(avg((reason IS NOT NULL)::INT), 4) AS escalation,
{', '.join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in H.REASONS)}, round(avg(seconds), 4) AS mean_seconds, round(avg(report_seconds), 4) AS mean_report_seconds, round(avg(ai::INT), 4) AS ai_share, round(avg(cropped::INT), 4) AS cropped_share,
round(avg(scaled::INT), 4) AS scale_share, count(*) FILTER (false_alarm) AS false_alarms, round(count(DISTINCT clause) / 244, 4) AS coverage FROM v_rev""")
def key_figures(spark, sf):
    return H.figures(reviewed(spark, sf))


@query(f"WITH {V_REVIEWED} SELECT report, count(*) AS n, round(avg(report_seconds), 4) AS mean_seconds FROM v_rev GROUP BY report")
def report_review(spark, sf):
    return H.report_review(reviewed(spark, sf))


@query(f"""WITH {V_REVIEWED}, m AS (SELECT avg(seconds) / 60 AS sec, 100 * avg((human <> rule)::INT) AS dis, avg(report_seconds) / 60 AS rsec FROM v_rev)
SELECT key, label, unit, lo AS base_lo, hi AS base_hi, goal, round(v, 4) AS value, v <= goal AS reached FROM (SELECT 'sec' AS key, '판독 소요시간' AS label, '분' AS unit, 30 AS lo, 60 AS hi, 5 AS goal, sec AS v FROM m
UNION ALL SELECT 'dis', '판정 불일치율', '%', 15, 20, 5, dis FROM m UNION ALL SELECT 'rsec', '보고서 작성', '분', 20, 30, 5, rsec FROM m)""")
def against_targets(spark, sf):
    return H.against_targets(reviewed(spark, sf))


@query(f"WITH {V_REVIEWED} SELECT part, {', '.join(f'''round(avg((human <> rule)::INT) FILTER (level = '{v}'), 6) AS {v}''' for v in ('L0', 'L1', 'L2'))} FROM v_rev GROUP BY part")
def level_by_part(spark, sf):
    return H.heatmap(reviewed(spark, sf), "part", "level", ["L0", "L1", "L2"])


@query("""SELECT count(*) AS regions, count(*) FILTER (o = 0) AS confirmed, count(*) FILTER (o = 1) AS wrong, count(*) FILTER (o = 2) AS again, round(100.0::DOUBLE * count(*) FILTER (o = 0) / count(*), 1) AS confirmed_percent,
round(100.0::DOUBLE * count(*) FILTER (o = 1) / count(*), 1) AS wrong_percent, round(100.0::DOUBLE * count(*) FILTER (o = 2) / count(*), 1) AS again_percent FROM (SELECT (l_orderkey * 7 + l_linenumber) % 11 % 3 AS o FROM lineitem)""")
def region_review(spark, sf):
    return H.region_review(table(spark, sf, "lineitem").select(((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 11 % 3).alias("outcome")))


@query("SELECT count(p_retailprice) AS n, round(avg(p_retailprice), 4) AS mean, round(stddev_samp(p_retailprice), 4) AS std, min(p_retailprice) AS least, round(quantile_cont(p_retailprice, 0.25), 4) AS q1, round(quantile_cont(p_retailprice, 0.5), 4) AS median, round(quantile_cont(p_retailprice, 0.75), 4) AS q3, max(p_retailprice) AS greatest FROM part")
def price_description(spark, sf):
    return H.described(table(spark, sf, "part"), "p_retailprice")


@query("SELECT count(*) AS files, round(avg((length(text) // 100 = 0)::INT), 6) AS empty, round(avg((length(text) // 100 <> n_chars // 110)::INT), 6) AS unequal FROM documents")
def parse_quality(spark, sf):
    return H.parse_quality(table(spark, sf, "documents").select(F.floor(F.length("text") / 100).alias("got"), F.floor(F.col("n_chars") / 110).alias("expected")))
