"""Similar-case search: scored join of queries to cases, diverse top-k, report."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions import geometry as G
from seamline.operators import near_profiles as C
from seamline.operators import profiles as P
from seamline.operators.blocks import against
from seamline.sources.tables import kept

# Similarities of different distribution classes (either way round).
CLOSE = {("산재", "군집"): 0.5, ("산재", "선상"): 0.3, ("군집", "선상"): 0.3, ("단독", "산재"): 0.2, ("단독", "군집"): 0.2}
WEIGHTS = (3.0, 2.0, 1.0)
FINE = 0.12
# The texts of the summary.
SUMMARY = "유사 사례 %d건 중 %d건이 실제로 기공 결함이 있었습니다 (위험도: %s). 가장 비슷했던 특징은 %s입니다. 이번 사진은 기공 %d개, 배치는 '%s'%s 입니다."
SUMMARY_SIZE = ", 크기는 대부분 '%s'"
AXES = {"distribution": "기공 배치 패턴", "shape": "기공 형태", "size": "기공 크기"}
FIELDS = ("n_instances", "distribution", "extent_ratio", "mean_nn_norm", "small", "medium", "large", "elongated", "mean_d", "kind")


CLASSES = ("해당없음", "단독", "산재", "군집", "선상")


def class_number(c: Column) -> Column:
    """A class as its place in CLASSES."""
    return F.array_position(F.lit(list(CLASSES)), c).cast("int") - 1


def similarities() -> list[float]:
    """Similarity of each class to each, row by row."""
    of = lambda x, y: 1.0 if x == y else CLOSE.get((x, y), CLOSE.get((y, x), 0.0))
    return [of(x, y) for x in CLASSES for y in CLASSES]


def class_similarity(a: Column, b: Column) -> Column:
    """Similarity of two classes given as numbers, from one table."""
    return F.get(F.lit(similarities()), a * len(CLASSES) + b)


def closeness(a: Column, b: Column) -> Column:
    return 1 - F.least(F.lit(1.0), F.abs(a - b))


def compared(a: Column, b: Column) -> dict[str, Column]:
    """Score and its parts for two profiles, structs a and b."""
    x, y = (lambda f: a[f]), (lambda f: b[f])
    both = class_similarity(x("kind"), y("kind"))
    extents = x("extent_ratio").isNotNull() & y("extent_ratio").isNotNull()
    dist = F.when(extents, 0.6 * both + 0.4 * closeness(x("extent_ratio"), y("extent_ratio"))).otherwise(both)
    shape = 1 - F.abs(x("elongated") - y("elongated"))
    size = 1 - (F.abs(x("small") - y("small")) + F.abs(x("medium") - y("medium")) + F.abs(x("large") - y("large"))) / 2
    n = 1 - F.least(F.lit(1.0), F.abs(x("n_instances") - y("n_instances")) / F.greatest(x("n_instances"), y("n_instances"), F.lit(1)))
    d = 1 - F.least(F.lit(1.0), F.abs(x("mean_d") - y("mean_d")) / F.greatest(x("mean_d"), y("mean_d"), F.lit(1e-6)))
    half = lambda f: F.when(x(f).isNotNull() & y(f).isNotNull(), closeness(x(f), y(f))).otherwise(0.5)
    fine = (n + d + half("extent_ratio") + half("mean_nn_norm")) / 4
    w = WEIGHTS
    coarse = (dist * w[0] + shape * w[1] + size * w[2]) / sum(w)
    return {"score": coarse * (1 - FINE) + fine * FINE, "s_distribution": dist, "s_shape": shape, "s_size": size, "s_fine": fine}


def scored(queries: DataFrame, cases: DataFrame) -> DataFrame:
    """Every query against every case, in blocks of queries. Columns query_id, case_id,
    q, c and the score's parts; what is not used of them is not computed."""
    kind = class_number(F.col("distribution"))
    q = queries.withColumn("kind", kind).select(F.col("image").alias("query_id"), F.struct(*FIELDS).alias("q"))
    c = cases.withColumn("kind", kind).select(F.col("image").alias("case_id"), F.struct(*FIELDS).alias("c"), *(["verdict"] if "verdict" in cases.columns else []))
    return against(c, q, "query_id").select("*", *(v.alias(k) for k, v in compared(F.col("q"), F.col("c")).items()))


def ranked(pairs: DataFrame, k: int, digits: int = 9, buckets: int = 256) -> DataFrame:
    """The k best cases of each query (score rounded, ties by case id), numbered.

    Pairs are not sorted: one hash aggregation gives each query's best score in each
    of `buckets` parts of the cases (at least 4 * k). The k-th of these is a score that k
    cases reach, so only pairs with as much go into the ranking."""
    from pyspark.sql import Window as W

    parts = max(buckets, 4 * k)
    score = F.round("score", digits)
    best = pairs.groupBy("query_id", F.pmod(F.xxhash64("case_id"), F.lit(parts)).alias("part")).agg(F.max(score).alias("best"))
    least = best.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("best"), asc=False), F.lit(k - 1)).alias("least")).select(F.col("query_id").alias("_query"), "least")
    # a row for each query, as many as are broadcast already
    near = pairs.join(F.broadcast(least), F.col("query_id") == F.col("_query")).where(F.col("least").isNull() | (score >= F.col("least"))).drop("_query", "least")
    return near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score), F.asc("case_id")))).where(F.col("rank") <= k)


def nearest(queries: DataFrame, cases: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """ranked(scored(queries, cases), k) without scoring every pair.

    Equal profiles stand for each other, so of each only the k smallest ids take part.
    near_profiles chooses the cases that can be among a query's best by bounds
    of cells of alike profiles; these are scored and ranked."""
    from pyspark.sql import Window as W

    kind = class_number(F.col("distribution"))
    of, weights = np.array(similarities()), np.array([*WEIGHTS, FINE])
    verdict = ["verdict"] if "verdict" in cases.columns else []
    same = W.partitionBy("distribution", *C.NUMBERS).orderBy("image")
    few = cases.select("image", "distribution", *C.NUMBERS, F.col("verdict") if verdict else F.lit(None).cast("string").alias("verdict"), F.row_number().over(same).alias("_same")).where(F.col("_same") <= k).drop("_same")
    asked = queries.select("image", "distribution", *C.NUMBERS, F.lit(None).cast("string").alias("verdict"))
    rows = kept(few.withColumn("query", F.lit(False)).unionByName(asked.withColumn("query", F.lit(True))).withColumns({"kind": kind, "image": F.col("image").cast("long")}), "case-profiles")
    cells = C.in_cells(rows, k, of, weights)
    found = C.candidates(cells, kept(C.met(cells, of, weights), "met-cells"), k, of, weights)
    types = {f.name: f.dataType for f in cases.schema}
    fields = {f: F.col(f).cast(types[f]) for f in C.NUMBERS} | {"distribution": F.col("distribution"), "kind": F.when(F.col("kind") >= -1, F.col("kind").cast("int"))}
    c = found.select("query_id", F.col("case_id").cast(types["image"]).alias("case_id"), "verdict", F.struct(*(fields[f].alias(f) for f in FIELDS)).alias("c"))
    q = queries.withColumn("kind", kind).select(F.col("image").alias("query_id"), F.struct(*FIELDS).alias("q"))
    both = c.withColumn("query_id", F.col("query_id").cast(queries.schema["image"].dataType)).join(q, "query_id")
    pairs = both.select("query_id", "case_id", "q", "c", *verdict, *(v.alias(name) for name, v in compared(F.col("q"), F.col("c")).items()))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), F.asc("case_id")))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def diverse(top: DataFrame, k: int = 5, trade: float = 0.5) -> DataFrame:
    """k cases of each query by maximal marginal relevance out of its pool (top: the best,
    ranked): the
    best first, then k - 1 rounds that add trade * score less (1 - trade) * the
    largest similarity to those chosen. A pool is one array, so a round compares its cases
    with the one chosen last only."""
    m = F.struct("rank", "case_id", "score", "c", F.lit(None).cast("double").alias("worst"), F.lit(False).alias("taken"))
    members = top.groupBy("query_id").agg(F.sort_array(F.collect_list(m)).alias("pool"))

    def take(pool: Column, place: Column) -> Column:
        """pool with its place taken, and every worst with the similarity to it."""

        def against_it(chosen: Column) -> Column:
            return F.transform(pool, lambda m: F.struct(*(m[f].alias(f) for f in ("rank", "case_id", "score", "c")), F.greatest(m["worst"], compared(m["c"], chosen["c"])["score"]).alias("worst"), (m["taken"] | (m["rank"] == place)).alias("taken")))

        return G.named(F.get(pool, place - 1), against_it)

    def step(pool: Column, _: Column) -> Column:
        free = F.filter(pool, lambda m: ~m["taken"])
        value = lambda m: F.struct((-F.round(trade * m["score"] - (1 - trade) * m["worst"], 9)).alias("v"), m["rank"].alias("rank"))
        return G.named(F.array_min(F.transform(free, value)), lambda best: F.when(best.isNull(), pool).otherwise(take(pool, best["rank"])))

    first = take(F.col("pool"), F.lit(1))
    state = members.select("query_id", F.aggregate(F.sequence(F.lit(1), F.lit(k - 1)), first, step).alias("pool") if k > 1 else first.alias("pool"))
    picked = F.filter("pool", lambda m: m["taken"])
    return state.select("query_id", F.posexplode_outer(picked).alias("place", "m")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("m.case_id").alias("case_id"), F.col("m.score").alias("score"))


NO_MATCH = "비교할 유사 사례가 없습니다."


def report(top: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row per query: counts, risk, mean similarity of each axis, the axis that
    fits best (of equals the first), the summary text and the matches
    (case:score:verdict, best first). Parts are rounded to 3 digits before their
    mean, and the axis is that of the unrounded mean. queries (query_id): those
    without matches get the form for none."""
    n = F.count(F.lit(1))
    thousandths = lambda c: F.sum(F.round(F.col(c) * 1000).cast("long"))
    match = F.struct("rank", F.format_string("%d:%.3f:%s", "case_id", F.round("score", 3), "verdict").alias("m"))
    got = top.groupBy("query_id").agg(
        n.alias("n_similar"), F.count_if(F.col("verdict") == "abnormal").alias("n_abnormal"),
        *(thousandths(f"s_{c}").alias(c) for c in AXES), F.first("q").alias("q"), F.array_join(F.transform(F.sort_array(F.collect_list(match)), lambda x: x["m"]), " ").alias("matches"),
    )
    ratio = F.col("n_abnormal") / F.col("n_similar")
    axis = F.when((F.col("distribution") >= F.col("shape")) & (F.col("distribution") >= F.col("size")), "distribution").when(F.col("shape") >= F.col("size"), "shape").otherwise("size")
    got = got.withColumns({"risk": F.when(ratio >= 0.6, "높음").when(ratio >= 0.3, "보통").otherwise("낮음"), "best_axis": axis})
    got = got.withColumns({c: F.round(F.col(c) / F.col("n_similar") / 1000, 3) for c in AXES})
    main = P.main_size(F.col("q.small"), F.col("q.medium"), F.col("q.large"))
    name = F.when(F.col("best_axis") == "distribution", AXES["distribution"]).when(F.col("best_axis") == "shape", AXES["shape"]).otherwise(AXES["size"])
    mostly = F.when(F.col("q.n_instances") > 0, F.format_string(SUMMARY_SIZE, main)).otherwise("")
    text = F.format_string(SUMMARY, "n_similar", "n_abnormal", "risk", name, F.col("q.n_instances"), F.col("q.distribution"), mostly)
    out = got.select("query_id", "n_similar", "n_abnormal", "risk", *AXES, "best_axis", text.alias("summary"), "matches")
    if queries is None:
        return out
    none = {"n_similar": F.lit(0), "n_abnormal": F.lit(0), "risk": F.lit("해당없음"), "summary": F.lit(NO_MATCH), "matches": F.lit("")}
    return queries.select("query_id").join(out, "query_id", "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()})


def screen_similarity(morphology: Column, size: Column, distribution: Column, location: Column) -> Column:
    """The work screen's own weighting, in percent to 1 digit."""
    return F.round(0.35 * morphology + 0.30 * size + 0.20 * distribution + 0.15 * location, 1)
