"""Queries: acceptance rules, verdict history, threshold evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.functions import acceptance as A
from seamline.operators import evaluation as E
from seamline.operators import history as H
from seamline.operators import judgement as J
from seamline.plans.proxies import GRADE, IGNORED, LENGTH_LIMIT, POINT_LIMIT, POINTS, SIZE_LIMIT, V_CASE, V_DEFECT, V_SCORES, cases, defects, margin_sql, scores, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {V_DEFECT} SELECT d, {POINTS.format('d')} AS points, count(*) AS n FROM v_defect GROUP BY d")
def rule_points(spark, sf):
    return defects(spark, sf).groupBy("d").agg(F.count(F.lit(1)).alias("n")).select("d", A.points(F.col("d")).alias("points"), "n")


@query(f"""SELECT t, CASE WHEN t <= 25 THEN '10x10' ELSE '10x20' END AS field, {SIZE_LIMIT} AS size_limit, {POINT_LIMIT} AS point_limit, {LENGTH_LIMIT} AS length_limit, {IGNORED} AS ignored_up_to
FROM (SELECT i::DOUBLE AS t FROM range(1, 121) r(i) UNION SELECT p_size::DOUBLE FROM part)""")
def rule_limits(spark, sf):
    """Thicknesses of all parts and, as every part may be thinner, of 1 to 120 mm."""
    parts = table(spark, sf, "part").select(F.col("p_size").cast("double").alias("t"))
    return J.limits(parts.union(spark.range(1, 121).select(F.col("id").cast("double"))).distinct())


@query(f"""WITH {V_DEFECT}, m AS ({margin_sql('v_defect')}), c AS (SELECT image, n, CASE WHEN image % 9 = 0 THEN 3.0::DOUBLE ELSE raw END AS raw, CASE WHEN image % 9 = 0 THEN 3.0::DOUBLE ELSE margin END AS margin FROM m) SELECT image, n, margin, (raw > 1)::INT AS rule FROM c""")
def crack_margin(spark, sf):
    """Every ninth image has a crack."""
    return J.with_cracks(J.porosity_margin(defects(spark, sf)), F.col("image") % 9 == 0).select("image", "n", "margin", "rule")


@query(f"WITH {V_DEFECT}, m AS ({margin_sql('v_defect')}) SELECT *, {GRADE.format('margin')} AS grade FROM m")
def rule_margin_grade(spark, sf):
    return J.porosity_margin(defects(spark, sf)).withColumn("grade", A.grade(F.col("margin")))


@query(f"WITH {V_DEFECT} SELECT image, t, round(sum(d), 6) AS length, round(round(sum(d), 6) / ({LENGTH_LIMIT}), 3) AS margin FROM v_defect GROUP BY image, t")
def rule_elongated_margin(spark, sf):
    out = J.elongated_margin(defects(spark, sf))
    return out.select("image", "t", F.round("length", 6).alias("length"), F.round(F.round("length", 6) / A.length_limit(F.col("t")), 3).alias("margin"))


@query(f"WITH {V_DEFECT}, m AS ({margin_sql('v_defect')}) SELECT {GRADE.format('margin')} AS grade, count(*) AS n FROM m GROUP BY 1")
def grade_distribution(spark, sf):
    return rule_margin_grade(spark, sf).groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {V_DEFECT}, m AS ({margin_sql('v_defect')}) SELECT image, CASE WHEN image % 10 <> 0 THEN margin END AS margin, CASE WHEN image % 10 <> 0 THEN CASE WHEN image % 97 = 0 THEN 4 ELSE {GRADE.format('margin')} END END AS grade,
CASE WHEN image % 10 = 0 THEN '보류' WHEN image % 97 = 0 OR margin > 1 THEN '불합격' ELSE '합격' END AS verdict FROM m""")
def judge_hold(spark, sf):
    images = J.porosity_margin(defects(spark, sf)).withColumn("spacing", F.when(F.col("image") % 10 != 0, 0.1))
    return J.judged(images, hard=F.col("image") % 97 == 0).select("image", "margin", "grade", "verdict")


AUDIT = f"""v_two AS (SELECT image, t, d AS major, d * 0.75::DOUBLE AS equivalent FROM v_defect), a AS ({margin_sql('v_two', d='major')}), b AS ({margin_sql('v_two', d='equivalent')}),
audit AS (SELECT image, t, a.margin AS margin_major, b.margin AS margin_equivalent, a.margin > 1 AND b.margin <= 1 AS flipped FROM a JOIN b USING (image, t))"""


@query(f"WITH {V_DEFECT}, {AUDIT} SELECT * FROM audit")
def audit_flip(spark, sf):
    return J.audited(defects(spark, sf).select("image", "t", F.col("d").alias("major"), (F.col("d") * 0.75).alias("equivalent")))


@query(f"WITH {V_DEFECT}, {AUDIT} SELECT count(*) AS images, count(*) FILTER (margin_major > 1) AS rejected, round(100.0::DOUBLE * count(*) FILTER (margin_major > 1) / count(*), 4) AS percent, count(*) FILTER (flipped) AS flips FROM audit")
def judge_batch(spark, sf):
    rejected = F.count_if(F.col("margin_major") > 1)
    return audit_flip(spark, sf).agg(F.count(F.lit(1)).alias("images"), rejected.alias("rejected"), F.round(100.0 * rejected / F.count(F.lit(1)), 4).alias("percent"), F.count_if("flipped").alias("flips"))


@query(f"""WITH {V_DEFECT}, g AS (SELECT image, gt.t, gs.scale, d * gs.scale AS d FROM v_defect, (VALUES (20.0::DOUBLE), (35.0), (50.0)) gt(t), (VALUES (0.5::DOUBLE), (1.0), (1.5)) gs(scale)), m AS ({margin_sql('g', by='image, t, scale')})
SELECT t, scale, count(*) AS images, count(*) FILTER (margin > 1) AS rejected, round(count(*) FILTER (margin > 1) / count(*)::DOUBLE, 6) AS reject_rate FROM m GROUP BY t, scale""")
def reject_sensitivity(spark, sf):
    return J.sensitivity(defects(spark, sf), [20.0, 35.0, 50.0], [0.5, 1.0, 1.5])


@query(f"""WITH {V_CASE} SELECT count(*) AS cases, round(avg((human = rule)::INT), 6) AS agreement, round(avg((human <> rule)::INT), 6) AS disagreement, round(avg((reason IS NOT NULL)::INT), 6) AS escalation, round(avg(seconds), 4) AS mean_seconds,
round(count(*) FILTER (rule = 1 AND human = 0) / count(*) FILTER (rule = 1)::DOUBLE, 6) AS lenient, count(DISTINCT part) AS parts FROM v_case""")
def kpi_overview(spark, sf):
    return H.overview(cases(spark, sf))


CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def pivot_sql(cell: str, rows: str, name: str = "cls") -> str:
    cells = ", ".join(f"{cell.format(f'{name} = {chr(39)}{c}{chr(39)}')} AS \"{c}\"" for c in CLASSES)
    return f"WITH {V_CASE} SELECT {rows}, {cells} FROM v_case GROUP BY {rows}"


@query(pivot_sql("round(avg((human <> rule)::INT) FILTER ({}), 6)", "part"))
def heatmap_part_defect(spark, sf):
    return H.heatmap(cases(spark, sf), "part", "cls", CLASSES)


@query(pivot_sql("count(*) FILTER ({})", "grade"))
def crosstab_grade_defect(spark, sf):
    return H.crosstab(cases(spark, sf), "grade", "cls", CLASSES)


@query(pivot_sql("round(avg((human <> rule)::INT) FILTER ({}), 6)", "inspector"))
def seniority_gap(spark, sf):
    return H.heatmap(cases(spark, sf), "inspector", "cls", CLASSES)


DAILY = "daily AS (SELECT day, count(*) AS n, round(avg((human = rule)::INT), 6) AS agreement FROM v_case GROUP BY day)"


@query(f"WITH {V_CASE}, {DAILY} SELECT * FROM daily")
def daily_agreement(spark, sf):
    return H.trend(cases(spark, sf))


@query(f"WITH {V_CASE}, {DAILY} SELECT *, round(avg(agreement) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving FROM daily")
def moving_agreement(spark, sf):
    return H.smoothed(H.trend(cases(spark, sf)))


@query(f"WITH {V_CASE} SELECT reason, count(*) AS n FROM v_case GROUP BY reason")
def escalation_cascade(spark, sf):
    return H.reason_counts(cases(spark, sf))


@query(f"""WITH {V_CASE}, q AS (SELECT image, day, reason, CASE reason WHEN 'rule_reject' THEN 0 WHEN 'mismatch' THEN 1 WHEN 'grey_zone' THEN 2 WHEN 'low_confidence' THEN 3 WHEN 'few_similar' THEN 4 WHEN 'scale_unknown' THEN 5 WHEN 'input_missing' THEN 6 ELSE 7 END AS priority, margin FROM v_case WHERE reason IS NOT NULL AND day >= 86)
SELECT * FROM q ORDER BY priority, margin DESC, image LIMIT 14""")
def escalation_queue(spark, sf):
    return H.queue(cases(spark, sf))


@query(f"""WITH {V_CASE}, g AS (SELECT part, cls, count(*) AS n, count(*) FILTER (senior <> rule) AS dev, avg(margin) FILTER (senior <> rule) AS m FROM v_case WHERE senior IS NOT NULL GROUP BY part, cls)
SELECT part, cls, n, dev, round(dev / n::DOUBLE, 4) AS r, round(m, 2) AS marg, CASE WHEN m > 1 THEN '관대' ELSE '엄격' END AS direction FROM g WHERE dev >= 4 ORDER BY r DESC, part, cls LIMIT 8""")
def tacit_candidates(spark, sf):
    return H.tacit(cases(spark, sf))


@query(f"WITH {V_CASE} SELECT image, sim, part || ' / ' || cls AS text FROM v_case WHERE sim < 0.45 ORDER BY sim, image LIMIT 16")
def retrieval_failures(spark, sf):
    return H.weak_retrieval(cases(spark, sf))


USES = "u AS (SELECT l_partkey AS clause, l_orderkey * 10 + l_linenumber AS seq FROM lineitem), c AS (SELECT p_partkey AS clause, p_type AS grp FROM part)"


def uses_and_clauses(spark, sf):
    uses = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("clause"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return uses, table(spark, sf, "part").select(F.col("p_partkey").alias("clause"), F.col("p_type").alias("grp"))


@query(f"WITH {USES}, n AS (SELECT clause, count(*) AS n, min(seq) AS first_seen FROM u GROUP BY clause) SELECT clause, n, first_seen, grp, row_number() OVER (ORDER BY n DESC, first_seen, clause) - 1 AS idx FROM n JOIN c USING (clause)")
def citation_usage(spark, sf):
    return H.citations(*uses_and_clauses(spark, sf))


@query(f"WITH {USES}, n AS (SELECT clause, count(*) AS n FROM u GROUP BY clause) SELECT grp, count(*) AS clauses, count(n) AS used, coalesce(sum(n), 0)::BIGINT AS uses FROM c LEFT JOIN n USING (clause) GROUP BY grp")
def citation_coverage(spark, sf):
    return H.coverage(*uses_and_clauses(spark, sf))


@query(f"""WITH {V_SCORES}, r AS (SELECT label, score, unnest(confs) AS conf FROM v_scores), b AS (SELECT CASE WHEN conf >= 0.15 AND conf < 0.30 THEN 0.15 WHEN conf >= 0.30 AND conf < 0.50 THEN 0.30 WHEN conf >= 0.5 AND conf < 0.7 THEN 0.5 WHEN conf >= 0.7 AND conf < 0.85 THEN 0.7 WHEN conf >= 0.85 AND conf < 1.01 THEN 0.85 END::DOUBLE AS low, label FROM r)
SELECT low, count(*) AS n, round(avg((label = 1)::INT), 6) AS agreement FROM b WHERE low IS NOT NULL GROUP BY low""")
def region_buckets(spark, sf):
    return H.confidence_buckets(scores(spark, sf).select(F.explode("confs").alias("conf"), (F.col("label") == 1).alias("agree")))


@query(f"""WITH {V_CASE}, h AS (SELECT part, avg((human = rule)::INT) FILTER (day < 45) AS a, avg((human = rule)::INT) FILTER (day >= 45) AS b FROM v_case GROUP BY part) SELECT part, round(a, 6) AS first_half, round(b, 6) AS second_half, round(b - a, 6) AS change FROM h""")
def sharp_drop(spark, sf):
    return H.sharp_drop(cases(spark, sf))


@query(f"""WITH {V_CASE}, b AS (SELECT inspector, least(floor(margin / 0.1::DOUBLE), 40)::INT AS b, count(*) FILTER (human = 1) AS bad, count(*) FILTER (human = 0) AS good FROM v_case GROUP BY 1, 2),
w AS (SELECT *, coalesce(sum(bad) OVER (PARTITION BY inspector ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + (sum(good) OVER (PARTITION BY inspector ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS wrong FROM b)
SELECT inspector, sum(bad + good)::BIGINT AS n, min(wrong) AS wrong, round(arg_min(b, wrong * 1000 + b) * 0.1::DOUBLE, 4) AS switch FROM w GROUP BY inspector""")
def inspector_switch(spark, sf):
    return H.switching_margin(cases(spark, sf))


@query(f"WITH {V_CASE} SELECT count(*) FILTER (grade = 4 AND human = 0) AS intolerable_passed, count(*) FILTER (rule = 0 AND human = 1) AS false_alarm, count(*) FILTER (rule = 1 AND human = 0) AS lenient_bias FROM v_case")
def alarm_cards(spark, sf):
    return H.alarms(cases(spark, sf))


@query(f"""WITH {V_CASE} SELECT image, 'RT-' || strftime(DATE '2026-07-01' + day, '%Y-%m%d') || '-' || lpad((image % 10000)::VARCHAR, 4, '0') AS case_id,
CASE WHEN human = rule THEN grade WHEN human = 0 THEN {GRADE.format('margin * 0.75::DOUBLE')} ELSE {GRADE.format('margin * 1.35::DOUBLE')} END AS human_grade,
round(1 / (1 + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, 6.0::DOUBLE * (margin - 0.9::DOUBLE))))), 6) AS reject_chance FROM v_case""")
def case_identity(spark, sf):
    c = F.col
    return cases(spark, sf).select("image", H.case_id(c("day"), c("image") % 10000).alias("case_id"), H.human_grade(c("human"), c("rule"), A.grade, c("margin"), c("grade")).alias("human_grade"), F.round(H.response(c("margin"), F.lit(0.9), F.lit(6.0)), 6).alias("reject_chance"))


@query("SELECT doc_id AS stem, CASE WHEN ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 2 = 0 THEN 'tune' ELSE 'test' END AS fold FROM documents")
def hash_split(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("stem"), E.fold(F.col("doc_id")).alias("fold"))


SWEEP = f"""{V_SCORES}, grid AS (SELECT round(0.01::DOUBLE + i * 0.01::DOUBLE, 3) AS thr FROM range(0, 95) r(i)),
x AS (SELECT thr, count(*) FILTER (label = 1 AND p) AS tp, count(*) FILTER (label = 0 AND p) AS fp, count(*) FILTER (label = 1 AND NOT p) AS fn, count(*) FILTER (label = 0 AND NOT p) AS tn FROM (SELECT thr, label, len(list_filter(confs, lambda c: c >= thr)) >= 1 AS p FROM v_scores, grid) GROUP BY thr),
y AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS specificity, coalesce(fp / nullif(tn + fp, 0)::DOUBLE, 0) AS fpr FROM x),
sweep AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy, (recall + specificity) / 2 AS balanced FROM y)"""
RATES = ("precision", "recall", "specificity", "fpr", "f1", "accuracy", "balanced")
ROUNDED = "thr, tp, fp, fn, tn, " + ", ".join(f"round({c}, 6) AS {c}" for c in RATES)


def rounded(df):
    return df.select("thr", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in RATES))


@query(f"WITH {SWEEP} SELECT {ROUNDED} FROM sweep")
def threshold_sweep(spark, sf):
    return rounded(E.sweep(scores(spark, sf)))


@query(f"WITH {SWEEP}, a AS (SELECT * FROM sweep WHERE recall >= 0.6 ORDER BY precision DESC, thr DESC LIMIT 1), b AS (SELECT * FROM sweep ORDER BY f1 DESC, thr DESC LIMIT 1), c AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a)) SELECT {ROUNDED} FROM c")
def operating_point(spark, sf):
    return rounded(E.operating_point(E.sweep(scores(spark, sf)), 0.6))


@query(f"WITH {SWEEP} SELECT {ROUNDED} FROM sweep WHERE thr = 0.35")
def evaluate_at(spark, sf):
    return rounded(E.sweep(scores(spark, sf), 0.35, 0.35))


@query(f"""WITH {V_SCORES}, s AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM v_scores GROUP BY score), r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT sum(p)::BIGINT AS pos, sum(n)::BIGINT AS neg, round((sum(n * (tp - p / 2.0::DOUBLE)) / (sum(p) * sum(n)))::DOUBLE, 6) AS roc_auc, round((sum(p * tp / (tp + fp)::DOUBLE) / sum(p))::DOUBLE, 6) AS average_precision FROM r""")
def roc_auc(spark, sf):
    return E.auc(scores(spark, sf))


@query(f"WITH {V_SCORES} SELECT source, count(*) AS n, count(*) FILTER (score >= 0.35) AS fp, round(count(*) FILTER (score >= 0.35) / count(*)::DOUBLE, 6) AS fpr FROM v_scores WHERE label = 0 GROUP BY source")
def fpr_by_source(spark, sf):
    return E.false_positives(scores(spark, sf), 0.35)


@query("""WITH i AS (SELECT p_partkey AS image, p_size * 60 AS width, p_size * 40 + 200 AS height FROM part),
y AS (SELECT *, unnest(list_distinct(list_append(range(0, greatest(height - 720, 0) + 1, 576), greatest(height - 720, 0)))) AS y FROM i),
x AS (SELECT *, unnest(list_distinct(list_append(range(0, greatest(width - 1280, 0) + 1, 1024), greatest(width - 1280, 0)))) AS x FROM y) SELECT image, width, height, greatest(width, 1280) AS padded_w, greatest(height, 720) AS padded_h, y::INT AS y, x::INT AS x FROM x""")
def tile_grid(spark, sf):
    return E.tiles(table(spark, sf, "part").select(F.col("p_partkey").alias("image"), (F.col("p_size") * 60).alias("width"), (F.col("p_size") * 40 + 200).alias("height")))
