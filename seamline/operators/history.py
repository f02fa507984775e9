"""Analytics over the verdict history: agreement, escalation, heatmaps, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.operators.order import numbered, quantiles


def rate(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole rounded; null over nothing."""
    return F.round(F.try_divide(part.cast("double"), whole), digits)


# The escalation reasons in their order.
REASONS = ("mismatch", "low_confidence", "unsupported", "scale_unknown", "rule_reject", "few_similar", "input_missing", "grey_zone")


def escalation(human: Column, rule: Column, ai_class: Column, conf: Column, supported: Column, scaled: Column, grade: Column, sim: Column, complete: Column, margin: Column) -> Column:
    """The first reason that holds, else null. Every test counts null as false."""
    tests = (human != rule, ai_class & (conf < 0.5), ~supported, ~scaled, (rule == 1) | (grade == 4), sim < 0.46, ~complete, margin.between(0.85, 1.18))
    out = F.when(tests[0], REASONS[0])
    for test, reason in zip(tests[1:], REASONS[1:]):
        out = out.when(test, reason)
    return out


def reason_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def priority(reason: Column, order=("rule_reject", "mismatch", "grey_zone", "low_confidence", "few_similar", "scale_unknown", "input_missing", "unsupported")) -> Column:
    """Place of a reason in the work queue (0 first)."""
    return F.get(F.transform(F.array(F.array_position(F.array(*map(F.lit, order)), reason)), lambda x: (x - 1).cast("int")), F.lit(0))


def queue(history: DataFrame, from_day: int = 86, size: int = 14) -> DataFrame:
    """The escalated cases of the last days by priority, then margin. Spark plans a
    take-ordered: each task keeps `size` rows, nothing is sorted globally."""
    rows = history.where(F.col("reason").isNotNull() & (F.col("day") >= from_day)).withColumn("priority", priority(F.col("reason")))
    return rows.orderBy("priority", F.desc("margin"), "image").limit(size).select("image", "day", "reason", "priority", "margin")


def managed(history: DataFrame, days: tuple[int, int] | None = None, **only) -> DataFrame:
    """The part of a history that all of a manager's figures share: days from and to
    (both included) and columns held to one value or one of a list; None holds none."""
    for column, wanted in ({"day": days} | only).items():
        if wanted is not None and column == "day" and days is not None:
            history = history.where(F.col("day").between(*days))
        elif wanted is not None:
            history = history.where(F.col(column).isin(*wanted) if isinstance(wanted, (list, tuple, set)) else F.col(column) == wanted)
    return history


def overview(history: DataFrame) -> DataFrame:
    """All key figures in one aggregation of one row."""
    n = F.count(F.lit(1))
    return history.agg(
        n.alias("cases"),
        rate(F.count_if(F.col("human") == F.col("rule")), n).alias("agreement"),
        rate(F.count_if(F.col("human") != F.col("rule")), n).alias("disagreement"),
        rate(F.count_if(F.col("reason").isNotNull()), n).alias("escalation"),
        F.round(F.avg("seconds"), 4).alias("mean_seconds"),
        rate(F.count_if((F.col("rule") == 1) & (F.col("human") == 0)), F.count_if(F.col("rule") == 1)).alias("lenient"),
        F.count_distinct("part").alias("parts"),
    )


def heatmap(history: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Disagreement rate by two categories as a matrix; cells without cases are null.
    The column values are given, so no job runs to find them."""
    return history.groupBy(rows).pivot(columns, values).agg(F.round(F.avg((F.col("human") != F.col("rule")).cast("double")), 6))


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts by two categories; absent cells are 0."""
    return df.groupBy(rows).pivot(columns, values).count().na.fill(0)


def trend(history: DataFrame) -> DataFrame:
    """Agreement by day."""
    return history.groupBy("day").agg(F.count(F.lit(1)).alias("n"), rate(F.count_if(F.col("human") == F.col("rule")), F.count(F.lit(1))).alias("agreement"))


def smoothed(daily: DataFrame, days: int = 7) -> DataFrame:
    """Moving mean of the daily agreement; a table of a row per day, so one task is enough."""
    w = W.orderBy("day").rowsBetween(-days + 1, 0)
    return daily.withColumn("moving", F.round(F.avg("agreement").over(w), 6))


def sharp_drop(history: DataFrame, half: int = 45) -> DataFrame:
    """Agreement of each part in the first and second half, and the change (definition ours)."""
    same = (F.col("human") == F.col("rule")).cast("double")
    out = history.groupBy("part").agg(F.avg(F.when(F.col("day") < half, same)).alias("a"), F.avg(F.when(F.col("day") >= half, same)).alias("b"))
    return out.select("part", F.round("a", 6).alias("first_half"), F.round("b", 6).alias("second_half"), F.round(F.col("b") - F.col("a"), 6).alias("change"))


def tacit(history: DataFrame, least: int = 4, size: int = 8) -> DataFrame:
    """Part and class groups where seniors often overrule the rule."""
    differs = F.col("senior") != F.col("rule")
    rows = history.where(F.col("senior").isNotNull()).groupBy("part", "cls").agg(F.count(F.lit(1)).alias("n"), F.count_if(differs).alias("dev"), F.avg(F.when(differs, F.col("margin"))).alias("mean"))
    rows = rows.where(F.col("dev") >= least).select("part", "cls", "n", "dev", F.round(F.col("dev") / F.col("n"), 4).alias("r"), F.round("mean", 2).alias("marg"), F.when(F.col("mean") > 1, "관대").otherwise("엄격").alias("direction"))
    return rows.orderBy(F.desc("r"), "part", "cls").limit(size)


def weak_retrieval(history: DataFrame, below: float = 0.45, size: int = 16) -> DataFrame:
    """Cases with the least similar best match."""
    return history.where(F.col("sim") < below).orderBy("sim", "image").limit(size).select("image", "sim", F.concat_ws(" / ", "part", "cls").alias("text"))


def citations(uses: DataFrame, clauses: DataFrame) -> DataFrame:
    """Clauses by number of uses (ties by first use, then clause), numbered from 0, with their group."""
    counted = uses.groupBy("clause").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seen"))
    placed = numbered(counted.join(clauses, "clause"), F.desc("n"), F.asc("first_seen"), F.asc("clause"), name="idx")
    return placed.withColumn("idx", (F.col("idx") - 1).cast("int"))


def coverage(uses: DataFrame, clauses: DataFrame) -> DataFrame:
    """Share of the clauses that are used, over all groups."""
    used = clauses.join(uses.select("clause").distinct(), "clause", "left").join(uses.groupBy("clause").agg(F.count(F.lit(1)).alias("n")), "clause", "left")
    return used.groupBy("grp").agg(F.count(F.lit(1)).alias("clauses"), F.count("n").alias("used"), F.coalesce(F.sum("n"), F.lit(0)).alias("uses"))


# The edges of the confidence buckets.
EDGES = (0.15, 0.30, 0.50, 0.70, 0.85, 1.01)


def confidence_buckets(regions: DataFrame, conf: str = "conf", good: str = "agree") -> DataFrame:
    """Agreement by confidence bucket; empty buckets are left out."""
    c = F.col(conf)
    low = None
    for a, b in zip(EDGES, EDGES[1:]):
        low = F.when((c >= a) & (c < b), a) if low is None else low.when((c >= a) & (c < b), a)
    return regions.withColumn("low", low).where("low is not null").groupBy("low").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(good).cast("double")), 6).alias("agreement"))


def switching_margin(history: DataFrame, bins: int = 40, width: float = 0.1) -> DataFrame:
    """The margin at which each inspector turns to reject (definition ours): the cut of
    the binned margin with the fewest decisions on the wrong side."""
    b = F.least(F.floor(F.col("margin") / width), F.lit(bins)).cast("int")
    cells = history.groupBy("inspector", b.alias("b")).agg(F.count_if(F.col("human") == 1).alias("bad"), F.count_if(F.col("human") == 0).alias("good"))
    before = W.partitionBy("inspector").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    onward = W.partitionBy("inspector").orderBy("b").rowsBetween(0, W.unboundedFollowing)
    # rejected below the cut, plus passed from the cut on
    wrong = F.coalesce(F.sum("bad").over(before), F.lit(0)) + F.sum("good").over(onward)
    cut = cells.withColumn("wrong", wrong).groupBy("inspector").agg(F.min(F.struct("wrong", "b")).alias("x"), F.sum(F.col("bad") + F.col("good")).alias("n"))
    return cut.select("inspector", "n", F.col("x.wrong").alias("wrong"), F.round(F.col("x.b") * width, 4).alias("switch"))


def alarms(history: DataFrame) -> DataFrame:
    """Counts behind the alarm cards (definitions ours)."""
    return history.agg(
        F.count_if((F.col("grade") == 4) & (F.col("human") == 0)).alias("intolerable_passed"),
        F.count_if((F.col("rule") == 0) & (F.col("human") == 1)).alias("false_alarm"),
        F.count_if((F.col("rule") == 1) & (F.col("human") == 0)).alias("lenient_bias"),
    )


def human_grade(human: Column, rule: Column, grade_of, margin: Column, rule_grade: Column) -> Column:
    """The inspector's grade: the rule's if they agree, else that of a shifted margin."""
    return F.when(human == rule, rule_grade).when(human == 0, grade_of(margin * 0.75)).otherwise(grade_of(margin * 1.35))


def case_id(day: Column, number: Column, start: str = "2026-07-01") -> Column:
    """RT-YYYY-MMDD-NNNN."""
    date = F.date_add(F.lit(start).cast("date"), day.cast("int"))
    return F.format_string("RT-%s-%04d", F.date_format(date, "yyyy-MMdd"), number)


def response(margin: Column, turn: Column, steepness: Column) -> Column:
    """Logistic chance to reject, the exponent held within 30."""
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), steepness * (margin - turn)))
    return 1 / (1 + F.exp(-x))


# Number of clauses in all; base range and goal of each target.
CLAUSES = 244
TARGETS = (("sec", "판독 소요시간", "분", 30, 60, 5), ("dis", "판정 불일치율", "%", 15, 20, 5), ("rsec", "보고서 작성", "분", 20, 30, 5))


def figures(history: DataFrame) -> DataFrame:
    """All key figures of the whole history in one row: rates, reasons, times (seconds),
    shares of cases with AI class, crop and scale, false alarms, coverage of clauses."""
    n = F.count(F.lit(1))
    share = lambda test, name: rate(F.count_if(test), n, 4).alias(name)
    return history.agg(
        n.alias("cases"), share(F.col("human") == F.col("rule"), "agreement"), share(F.col("human") != F.col("rule"), "disagreement"), share(F.col("reason").isNotNull(), "escalation"),
        *(F.count_if(F.col("reason") == r).alias(r) for r in REASONS),
        F.round(F.avg("seconds"), 4).alias("mean_seconds"), F.round(F.avg("report_seconds"), 4).alias("mean_report_seconds"),
        share(F.col("ai"), "ai_share"), share(F.col("cropped"), "cropped_share"), share(F.col("scaled"), "scale_share"),
        F.count_if("false_alarm").alias("false_alarms"), rate(F.count_distinct("clause"), F.lit(CLAUSES), 4).alias("coverage"),
    )


def region_review(regions: DataFrame) -> DataFrame:
    """Regions by outcome (0 confirmed, 1 wrong, 2 to inspect again), with percentages."""
    n, of = F.count(F.lit(1)), {"confirmed": 0, "wrong": 1, "again": 2}
    counts = [F.count_if(F.col("outcome") == v).alias(k) for k, v in of.items()]
    return regions.agg(n.alias("regions"), *counts).select("*", *(F.round(F.try_divide(100.0 * F.col(k), F.col("regions")), 1).alias(f"{k}_percent") for k in of))


def report_review(history: DataFrame) -> DataFrame:
    """Cases and mean time of each outcome of the report's review."""
    return history.groupBy("report").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("report_seconds"), 4).alias("mean_seconds"))


def against_targets(history: DataFrame) -> DataFrame:
    """The three figures beside their base range and goal (minutes, percent)."""
    value = {"sec": F.avg("seconds") / 60, "dis": 100 * F.avg((F.col("human") != F.col("rule")).cast("int")), "rsec": F.avg("report_seconds") / 60}
    row = history.agg(*(v.alias(k) for k, v in value.items()))
    lines = [F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), F.lit(unit).alias("unit"), F.lit(lo).alias("base_lo"), F.lit(hi).alias("base_hi"), F.lit(goal).alias("goal"), F.round(k, 4).alias("value"), (F.col(k) <= goal).alias("reached")) for k, label, unit, lo, hi, goal in TARGETS]
    return row.select(F.inline(F.array(*lines)))


def described(rows: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, least, quartiles (exact, interpolated) and greatest of a column."""
    c = F.col(column)
    quarters = (F.round(F.lit(q).cast("double"), 4).alias(k) for k, q in zip(("q1", "median", "q3"), quantiles(rows, column, [0.25, 0.5, 0.75])))
    return rows.agg(F.count(c).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev(c), 4).alias("std"), F.min(c).alias("least"), F.max(c).alias("greatest")).select("n", "mean", "std", "least", *quarters, "greatest")


def parse_quality(files: DataFrame) -> DataFrame:
    """Share of files where nothing was found, and where another number than expected was."""
    part = lambda test: F.round(F.avg(test.cast("int")), 6)
    return files.agg(F.count(F.lit(1)).alias("files"), part(F.col("got") == 0).alias("empty"), part(F.col("got") != F.col("expected")).alias("unequal"))
