"""Quality rules: a learned, ordered decision list over text statistics (operator 9).

Statistics come from one pass over whole texts with Spark functions alone. The
list is learned from labelled documents by sequential covering: each rule is a
conjunction of thresholds, grown on two thirds of the sample by information
gain and pruned on the last third; rows that it covers leave the sample. Counts
for all candidate conditions of a step are one Spark aggregation over binned
statistics, of which at most features x bins x 2 rows come to the driver. The
list is emitted as one conditional expression.

The only bound: at most `sample` labelled documents (those with the smallest
hash of their id) train the list. All documents are scored.

Null and empty texts have zero statistics and fail the base (fewer than 20
words). Labels that are null are ignored, of repeated labels the least counts;
without labels the list is empty and only the base decides. Repeated and null
ids are kept row by row; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.shared import WHITE, table, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words in the windows whose repetition is counted.
WINDOW = 8


def repeated_words(h: Column) -> Column:
    """Words covered by windows that occur twice or more; h: hash of the window at each word."""
    n = F.size(h)
    ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: ((k > 0) & (x["h"] == F.get(s, k - 1)["h"])) | ((k < n - 1) & (x["h"] == F.get(s, k + 1)["h"])))
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")), lambda acc: acc["n"])

    # array of one element: binds the sorted array to a name
    return F.when(F.size(F.array_distinct(h)) == n, F.lit(0).cast("long")).otherwise(F.get(F.transform(F.array(ranked), covered), F.lit(0)))


def text_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(SPACES))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    parts = text.select(
        "doc_id",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WHITE}]+")).alias("w"),
        lines.alias("lines"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    windows = F.when(F.size("w") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW))))
    hashed = parts.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        windows.alias("h"),
    )
    out = hashed.select("doc_id", F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("h")).alias("n_repeat_words"), "n_lines").alias("s"))
    # a generator: filters on the statistics must not move below it and compute them again
    return out.select("doc_id", F.explode_outer(F.array("s")).alias("s")).select("doc_id", "s.*")


def share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))


#: What rules may look at.
FEATURES = {
    "symbol_share": lambda: share("n_symbols", "word_chars"),
    "repeat_share": lambda: share("n_repeat_words", "n_words"),
    "dup_line_share": lambda: share("n_dup_lines", "n_lines"),
    "word_length": lambda: share("word_chars", "n_words"),
    "n_words": lambda: F.col("n_words").cast("double"),
    "words_a_line": lambda: share("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self) -> Column:
        value = FEATURES[self.feature]()
        return value > self.threshold if self.above else value <= self.threshold


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional: false at the first rule that holds, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column()
        out = F.when(holds, F.lit(False)).otherwise(out)
    return out


def learn(stats: DataFrame, labels: DataFrame, sample: int = 20_000, bins: int = 32, precision: float = 0.9, least: int = 3, most_rules: int = 8) -> list[list[Condition]]:
    """Rules for documents to reject (quality 0), learned from at most `sample`
    labelled rows. A rule is taken if on the pruning rows its precision reaches
    `precision` and on all rows it covers `least` or more bad documents."""
    marked = labels.where("quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    rows = stats.join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = written(rows.select("doc_id", "bad", *(f().alias(k) for k, f in FEATURES.items())), "labelled")
    names = list(FEATURES)
    cuts = rows.agg(*(F.percentile_approx(k, [i / bins for i in range(bins)], 1000).alias(k) for k in names)).first()
    edges = {k: sorted(set(cuts[k] or [])) for k in names}

    def bin_of(name: str) -> Column:
        """How many thresholds lie below the value."""
        return F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges[name])).cast("array<double>"), lambda e: F.col(name) > e))

    binned = rows.select(
        "bad",
        (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0).alias("grow"),
        F.array(*(bin_of(k) for k in names)).alias("bin"),
    )
    data = written(binned, "binned")

    def holds(rule: list[Condition]) -> Column:
        out = F.lit(True)
        for c in rule:
            b = F.get(F.col("bin"), F.lit(names.index(c.feature)))
            at = edges[c.feature].index(c.threshold)
            out = out & (b > at if c.above else b <= at)
        return out

    def counts(where: Column) -> dict:
        got = data.where(where).select("bad", F.posexplode("bin").alias("f", "b")).groupBy("f", "b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
        return {(r.f, r.b): (r.p, r.n) for r in got.collect()}  # at most features x bins rows

    def best(table: dict, rule: list[Condition]) -> tuple[float, Condition | None]:
        total = [sum(v[i] for (f, _), v in table.items() if f == 0) for i in (0, 1)]
        base = math.log2((total[0] + 1) / (sum(total) + 2))
        top = (0.0, None)
        for f, name in enumerate(names):
            p = n = 0
            for at, threshold in enumerate(edges[name]):
                low = table.get((f, at), (0, 0))
                p, n = p + low[0], n + low[1]
                for above, (a, b) in ((False, (p, n)), (True, (total[0] - p, total[1] - n))):
                    if a >= least:
                        gain = a * (math.log2((a + 1) / (a + b + 2)) - base)
                        if gain > top[0] + 1e-9:
                            top = (gain, Condition(name, above, threshold))
        return top

    rules: list[list[Condition]] = []
    free = F.lit(True)
    while len(rules) < most_rules:
        rule: list[Condition] = []
        while len(rule) < 4:
            table = counts(free & F.col("grow") & holds(rule))
            if not table or sum(v[1] for (f, _), v in table.items() if f == 0) == 0:
                break
            gain, c = best(table, rule)
            if c is None:
                break
            rule.append(c)
        if not rule:
            break
        # prune: the shortest prefix with the best value on the other rows
        kept = data.where(free & ~F.col("grow"))
        every = [rule[: k + 1] for k in range(len(rule))]
        sums = kept.agg(*(F.count_if(holds(r) & (F.col("bad") == b)) for r in every for b in (True, False))).first()
        value = [(sums[2 * k] - sums[2 * k + 1]) / max(1, sums[2 * k] + sums[2 * k + 1]) for k in range(len(every))]
        k = max(range(len(every)), key=lambda i: (value[i], -i))
        if sums[2 * k] < precision * max(1, sums[2 * k] + sums[2 * k + 1]) or sums[2 * k] < 1:
            break
        rules.append(every[k])
        free = free & ~holds(every[k])
    return rules


def judged(stats: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """stats with base_failed and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


def quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **learning) -> DataFrame:
    """One row per document with its statistics, base_failed and kept."""
    stats = written(text_statistics(docs, id_column, text_column), "statistics")
    return judged(stats, learn(stats, labels, **learning))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE_SQL: dict[str, str] = {}
