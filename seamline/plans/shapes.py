"""Queries: polygon geometry, case profiles, similar cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions import geometry as G
from seamline.operators import profiles as P
from seamline.operators import similarity as S
from seamline.plans.proxies import table
from seamline.sources.tables import kept

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def polygons(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id and its 32 points."""
    return table(spark, sf, "embeddings").select("vec_id", G.from_flat(F.col("embedding")).alias("p"))


V_POLY = """v_xy AS (SELECT vec_id, i, embedding[2 * i + 1]::DOUBLE AS x, embedding[2 * i + 2]::DOUBLE AS y FROM embeddings, range(0, 32) r(i)),
v_next AS (SELECT a.vec_id, sum(a.x * b.y - b.x * a.y) AS s FROM v_xy a JOIN v_xy b ON a.vec_id = b.vec_id AND b.i = (a.i + 1) % 32 GROUP BY a.vec_id),
v_far AS (SELECT a.vec_id, max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS major FROM v_xy a JOIN v_xy b ON a.vec_id = b.vec_id GROUP BY a.vec_id),
v_cov AS (SELECT vec_id, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM v_xy GROUP BY vec_id),
v_eig AS (SELECT *, greatest((xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy * xy), 1e-9) AS hi, greatest((xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy * xy), 1e-9) AS lo FROM v_cov)"""


@query(f"WITH {V_POLY} SELECT vec_id, round(abs(s) / 2, 6) AS area, round(2 * sqrt(abs(s) / 2 / pi()), 6) AS equivalent FROM v_next")
def polygon_area(spark, sf):
    return polygons(spark, sf).select("vec_id", G.area(F.col("p")).alias("a")).select("vec_id", F.round("a", 6).alias("area"), F.round(G.equivalent_diameter(F.col("a")), 6).alias("equivalent"))


@query(f"WITH {V_POLY} SELECT vec_id, round(major, 6) AS major FROM v_far")
def polygon_major(spark, sf):
    return polygons(spark, sf).select("vec_id", F.round(G.major_diameter(F.col("p")), 6).alias("major"))


@query(f"WITH {V_POLY} SELECT vec_id, round(cx, 6) AS x, round(cy, 6) AS y FROM v_cov")
def polygon_centroid(spark, sf):
    return polygons(spark, sf).select("vec_id", G.centroid(F.col("p")).alias("c")).select("vec_id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query(f"WITH {V_POLY} SELECT vec_id, round(sqrt(hi / lo), 6) AS elongation, CASE WHEN sqrt(hi / lo) >= 1.8 THEN '길쭉한' ELSE '원형/구형' END AS shape FROM v_eig")
def polygon_elongation(spark, sf):
    return polygons(spark, sf).select("vec_id", F.round(G.elongation(F.col("p")), 6).alias("elongation"), G.shape(F.col("p")).alias("shape"))


@query("""WITH p AS (SELECT vec_id, i, (embedding[2 * i + 1]::DOUBLE + 0.5) * 1280 AS x, CASE WHEN vec_id % 5 = 0 THEN 300.0::DOUBLE ELSE (embedding[2 * i + 2]::DOUBLE + 0.5) * 720 END AS y FROM embeddings, range(0, 32) r(i)),
n AS (SELECT vec_id, k + 1 AS place, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, x / 1280)), 6) AS x, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, y / 720)), 6) AS y FROM range(0, 20) r(k) JOIN p ON i = k * 32 // 20)
SELECT vec_id, CASE WHEN vec_id % 5 > 0 THEN count(*)::INT END AS points, CASE WHEN vec_id % 5 > 0 THEN round(sum(place * x), 3) END AS sx, CASE WHEN vec_id % 5 > 0 THEN round(sum(place * y), 3) END AS sy FROM n GROUP BY vec_id""")
def normalize_polygon(spark, sf):
    """Closed polygons with every point twice, thinned from 32 points to 20; every fifth lies flat and has no area."""
    y = lambda p: F.when(F.col("vec_id") % 5 == 0, 300.0).otherwise((p["y"] + 0.5) * 720)
    px = F.transform("p", lambda p: F.struct(((p["x"] + 0.5) * 1280).alias("x"), y(p).alias("y")))
    twice = F.flatten(F.transform(px, lambda p: F.array(p, p)))
    norm = polygons(spark, sf).select("vec_id", F.concat(twice, F.slice(px, 1, 1)).alias("px")).select("vec_id", G.normalised(F.col("px"), F.lit(1280.0), F.lit(720.0), most=20).alias("n"))
    placed = lambda c: G.rounded(F.aggregate(F.transform("n", lambda p, i: (i + 1) * p[c]), F.lit(0.0), lambda a, x: a + x), 3)
    return norm.select("vec_id", F.when(F.col("n").isNotNull(), F.size("n")).alias("points"), placed("x").alias("sx"), placed("y").alias("sy"))


@query("SELECT quantile_cont(value, 0.33) AS lo, quantile_cont(value, 0.67) AS hi FROM events WHERE value > 0")
def size_thresholds(spark, sf):
    return P.size_thresholds(table(spark, sf, "events"), "value")


def instances(spark: SparkSession, sf: str) -> DataFrame:
    """Defect instances placed by whole-number hashes; a third of the images is tight."""
    c = F.col
    tight = F.when(c("l_orderkey") % 3 == 0, 0.04).otherwise(1.0)
    return table(spark, sf, "lineitem").select(c("l_orderkey").alias("image"), ((c("l_partkey") * 7919 % 1280) * tight).alias("x"), ((c("l_suppkey") * 104729 % 720) * tight).alias("y"), (c("l_quantity") * 0.2).alias("d"), (c("l_linenumber") % 3 == 0).alias("elongated"), F.lit(1280.0).alias("w"), F.lit(720.0).alias("h"))


V_PROFILE = """v_inst AS (SELECT row_number() OVER () AS rid, l_orderkey AS image, (l_partkey * 7919 % 1280) * CASE WHEN l_orderkey % 3 = 0 THEN 0.04::DOUBLE ELSE 1.0::DOUBLE END AS x, (l_suppkey * 104729 % 720) * CASE WHEN l_orderkey % 3 = 0 THEN 0.04::DOUBLE ELSE 1.0::DOUBLE END AS y,
  l_quantity * 0.2::DOUBLE AS d, l_linenumber % 3 = 0 AS elongated FROM lineitem),
v_thr AS (SELECT quantile_cont(d, 0.33) AS lo, quantile_cont(d, 0.67) AS hi FROM v_inst WHERE d > 0),
v_pair AS (SELECT a.image, a.rid, max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS far, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS near FROM v_inst a JOIN v_inst b ON a.image = b.image AND a.rid <> b.rid GROUP BY a.image, a.rid),
v_dist AS (SELECT image, max(far) AS extent, avg(near) AS near FROM v_pair GROUP BY image),
v_agg AS (SELECT image, count(*)::INT AS n, max(x) - min(x) AS dx, max(y) - min(y) AS dy, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy, count(*) FILTER (d < lo) / count(*)::DOUBLE AS small, count(*) FILTER (d >= lo AND d < hi) / count(*)::DOUBLE AS medium,
  count(*) FILTER (d >= hi) / count(*)::DOUBLE AS large, avg(elongated::INT) AS elongated, avg(d) AS mean_d FROM v_inst, v_thr GROUP BY image),
v_eig AS (SELECT *, greatest((xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy * xy), 1e-9) AS hi, greatest((xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy * xy), 1e-9) AS lo FROM v_agg),
v_all AS (SELECT *, extent / sqrt(1280.0::DOUBLE * 1280 + 720 * 720) AS e, hi / (hi + lo) AS lin FROM v_eig LEFT JOIN v_dist USING (image)),
v_profile AS (SELECT image, CASE WHEN n = 1 THEN '단독' WHEN e <= 0.05 THEN '군집' WHEN n >= 8 AND lin >= 0.9 THEN '선상' ELSE '산재' END AS distribution, n AS n_instances, CASE WHEN n >= 2 THEN round(e, 4) END AS extent_ratio,
  CASE WHEN n >= 2 THEN round(CASE WHEN extent > 0 THEN near / extent ELSE 0 END, 4) END AS mean_nn_norm, CASE WHEN n >= 2 THEN round(dx * dy / (1280.0::DOUBLE * 720), 4) END AS spread_ratio, CASE WHEN n >= 8 AND e > 0.05 THEN round(lin, 4) END AS linear_ratio, small, medium, large, elongated, mean_d FROM v_all)"""


def case_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = instances(spark, sf)
    return P.profiles(rows, P.size_thresholds(rows), ["image"])


@query(f"WITH {V_PROFILE} SELECT image, distribution, n_instances, extent_ratio, mean_nn_norm, floor(spread_ratio * 100)::BIGINT AS spread_percent FROM v_profile")
def distribution_class(spark, sf):
    return case_table(spark, sf).select("image", "distribution", "n_instances", "extent_ratio", "mean_nn_norm", F.floor(F.col("spread_ratio") * 100).alias("spread_percent"))


@query(f"WITH {V_PROFILE} SELECT image, distribution, round(small, 6) AS small, round(medium, 6) AS medium, round(large, 6) AS large, round(elongated, 6) AS elongated, round(mean_d, 6) AS mean_d FROM v_profile")
def case_profile(spark, sf):
    return case_table(spark, sf).select("image", "distribution", *(F.round(c, 6).alias(c) for c in ("small", "medium", "large", "elongated", "mean_d")))


@query(f"WITH {V_PROFILE} SELECT distribution, count(*) FILTER (image % 2 = 0) AS even, count(*) FILTER (image % 2 = 1) AS odd FROM v_profile GROUP BY distribution")
def crosstab_distribution(spark, sf):
    return case_table(spark, sf).groupBy("distribution").agg(F.count_if(F.col("image") % 2 == 0).alias("even"), F.count_if(F.col("image") % 2 == 1).alias("odd"))


CLASS = "CASE WHEN a.distribution = b.distribution THEN 1.0::DOUBLE WHEN (a.distribution, b.distribution) IN (('산재', '군집'), ('군집', '산재')) THEN 0.5 WHEN (a.distribution, b.distribution) IN (('산재', '선상'), ('선상', '산재'), ('군집', '선상'), ('선상', '군집')) THEN 0.3 WHEN (a.distribution, b.distribution) IN (('단독', '산재'), ('산재', '단독'), ('단독', '군집'), ('군집', '단독')) THEN 0.2 ELSE 0.0 END"
V_SIMILAR = f"""{V_PROFILE}, v_pairs AS (SELECT a.image AS query_id, b.image AS case_id, a.n_instances AS qn, a.distribution AS qd, a.small AS qs, a.medium AS qm, a.large AS ql,
  CASE WHEN a.extent_ratio IS NOT NULL AND b.extent_ratio IS NOT NULL THEN 0.6::DOUBLE * ({CLASS}) + 0.4::DOUBLE * (1 - least(1.0::DOUBLE, abs(a.extent_ratio - b.extent_ratio))) ELSE {CLASS} END AS s_distribution, 1 - abs(a.elongated - b.elongated) AS s_shape,
  1 - (abs(a.small - b.small) + abs(a.medium - b.medium) + abs(a.large - b.large)) / 2 AS s_size,
  ((1 - least(1.0::DOUBLE, abs(a.n_instances - b.n_instances) / greatest(a.n_instances, b.n_instances, 1)::DOUBLE)) + (1 - least(1.0::DOUBLE, abs(a.mean_d - b.mean_d) / greatest(a.mean_d, b.mean_d, 1e-6::DOUBLE)))
   + coalesce(1 - least(1.0::DOUBLE, abs(a.extent_ratio - b.extent_ratio)) + 0 * a.extent_ratio * b.extent_ratio, 0.5::DOUBLE) + coalesce(1 - least(1.0::DOUBLE, abs(a.mean_nn_norm - b.mean_nn_norm)) + 0 * a.mean_nn_norm * b.mean_nn_norm, 0.5::DOUBLE)) / 4 AS s_fine
  FROM v_profile a, v_profile b WHERE a.image % 100 = 0),
v_scored AS (SELECT *, (s_distribution * 3 + s_shape * 2 + s_size) / 6 * 0.88::DOUBLE + s_fine * 0.12::DOUBLE AS score FROM v_pairs),
v_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, case_id) AS rank FROM v_scored QUALIFY rank <= 5)"""


def nearest(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Images whose id is divisible by 100 against all, the case base; profiles are made once."""
    cases = kept(case_table(spark, sf), "profiles")
    base = cases.withColumn("verdict", F.when(F.col("image") % 5 < 2, "abnormal").otherwise("normal"))
    return S.nearest(cases.where("image % 100 = 0"), base, k)


@query(f"WITH {V_SIMILAR} SELECT query_id, case_id, rank::INT AS rank, round(score, 6) AS score, round(s_distribution, 3) AS s_distribution, round(s_shape, 3) AS s_shape, round(s_size, 3) AS s_size FROM v_top")
def similar_topk(spark, sf):
    return nearest(spark, sf, 5).select("query_id", "case_id", "rank", F.round("score", 6).alias("score"), *(F.round(c, 3).alias(c) for c in ("s_distribution", "s_shape", "s_size")))


@query()
def similar_mmr(spark, sf):
    return S.diverse(nearest(spark, sf, 50)).withColumn("score", F.round("score", 6))


#: Matches of the report have this score or more, so some queries have none.
ALIKE = 0.97


@query(f"""WITH {V_SIMILAR}, m AS (SELECT *, round(s_distribution, 3) AS d3, round(s_shape, 3) AS s3, round(s_size, 3) AS z3 FROM v_top WHERE score >= {ALIKE}),
g AS (SELECT query_id, count(*) AS n_similar, count(*) FILTER (case_id % 5 < 2) AS n_abnormal, sum(round(d3 * 1000)::BIGINT) AS d, sum(round(s3 * 1000)::BIGINT) AS s, sum(round(z3 * 1000)::BIGINT) AS z, any_value(qn) AS qn, any_value(qd) AS qd, any_value(qs) AS qs, any_value(qm) AS qm, any_value(ql) AS ql,
  string_agg(printf('%d:%.3f:', case_id, round(score, 3)) || CASE WHEN case_id % 5 < 2 THEN 'abnormal' ELSE 'normal' END, ' ' ORDER BY rank) AS matches FROM m GROUP BY query_id),
r AS (SELECT *, CASE WHEN n_abnormal / n_similar::DOUBLE >= 0.6 THEN '높음' WHEN n_abnormal / n_similar::DOUBLE >= 0.3 THEN '보통' ELSE '낮음' END AS risk, CASE WHEN d >= s AND d >= z THEN 'distribution' WHEN s >= z THEN 'shape' ELSE 'size' END AS best_axis FROM g),
t AS (SELECT query_id, n_similar, n_abnormal, risk, round(d / n_similar / 1000::DOUBLE, 3) AS distribution, round(s / n_similar / 1000::DOUBLE, 3) AS shape, round(z / n_similar / 1000::DOUBLE, 3) AS size, best_axis, matches, printf('{S.SUMMARY}', n_similar, n_abnormal, risk, CASE best_axis WHEN 'distribution' THEN '{S.AXES["distribution"]}' WHEN 'shape' THEN '{S.AXES["shape"]}' ELSE '{S.AXES["size"]}' END, qn, qd,
printf('{S.SUMMARY_SIZE}', CASE WHEN qs >= qm AND qs >= ql THEN '소' WHEN qm >= ql THEN '중' ELSE '대' END)) AS summary FROM r)
SELECT p.image AS query_id, coalesce(n_similar, 0) AS n_similar, coalesce(n_abnormal, 0) AS n_abnormal, coalesce(risk, '해당없음') AS risk, t.distribution, t.shape, t.size, best_axis, coalesce(summary, '{S.NO_MATCH}') AS summary, coalesce(matches, '') AS matches
FROM v_profile p LEFT JOIN t ON t.query_id = p.image WHERE p.image % 100 = 0""".replace("'%s'", "''%s''"))
def similar_report(spark, sf):
    top = nearest(spark, sf, 5).where(F.col("score") >= ALIKE)
    queries = table(spark, sf, "lineitem").where("l_orderkey % 100 = 0").select(F.col("l_orderkey").alias("query_id")).distinct()
    return S.report(top, queries)
