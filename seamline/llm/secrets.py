"""Secret scans: patterns and character Markov models (operator 10).

Base: three kinds of spans by regular expressions, with a least length. Method:
every run of 16 or more key characters outside base spans is scored by two first-order
character Markov models, one of random strings and one of ordinary words; a run
with a stretch whose log-likelihood ratio exceeds the logarithm of `odds` (how many
ordinary runs are expected for a random one) is a span of kind `markov`. All of
it is Spark expressions over one scan of the texts, after one that marks the
training sample.

Training sample: the values that base patterns find (random strings) and the
other words that occur at least twice in the sample (ordinary; strings that
nothing labels as secret but are random hardly recur), from at most `sample` documents with and as many
without base spans, those with the smallest hash of their id. Pair counts are
aggregated by Spark; at most alphabet squared rows (68 x 68 x 2) come to the
driver. Without any base span in the table there is nothing to learn from and no
markov spans are added.

Positions come from the pieces between matches. Matches are gathered in chunks, so
the work for a text with m matches grows with m (beyond millions, slowly with its
square); no match is dropped, and texts may be of any length.

Null and empty texts have no spans: counts 0, the hash of the empty string, and
an empty list. Rows are kept one for one, repeated and null ids included; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.shared import table, written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The base kinds in their order: name, pattern, group whose length counts, least length.
KINDS = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
#: Quick tests that hold wherever a match of sufficient length exists.
QUICK = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
#: For these, shorter matches cannot change where the longer ones are.
LONG = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
RUN = r"[A-Za-z0-9+/_.=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SPAN = "array<struct<start:int,kind_no:int,kind:string,stop:int>>"
VALUED = "array<struct<start:int,kind_no:int,kind:string,stop:int,value:string>>"
#: Matches, characters or parts that are gathered before they are moved to the whole.
CHUNK = 512


def spans(text: Column, pattern: str, group: int, least: int, kind: str, number: int) -> Column:
    """All matches as spans in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    length = F.transform(found, lambda x: F.length(x))
    steps = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), length.alias("length"))
    rows = F.arrays_zip(bound(steps, starts).alias("start"), length.alias("length"), size.alias("size"), found.alias("value"))
    one = lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), (x["start"] + x["length"]).alias("stop"), x["value"].alias("value"))
    return F.transform(F.filter(rows, lambda x: x["size"] >= least), one)


def bound(value: Column, f) -> Column:
    """f of a value that is computed once: an array of one element binds it to a name."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def starts(steps: Column) -> Column:
    """Where each match starts, from gaps and lengths. What an aggregation carries along is
    copied at every step, so sums run over pieces of CHUNK matches, and then over the pieces."""
    none = F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def within(piece: Column) -> Column:
        return F.aggregate(piece, zero, lambda acc, x: F.struct((acc["at"] + x["gap"] + x["length"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["gap"])).alias("out")))

    def over(pieces: Column) -> Column:
        before = F.aggregate(pieces, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(pieces, before, lambda x, far: F.transform(x["out"], lambda at: at + far)))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda k: within(F.slice(steps, k * CHUNK + 1, F.lit(CHUNK))))
    return F.when(F.size(steps) > 0, bound(pieces, over)).otherwise(none)


def without_values(x: Column) -> Column:
    return F.transform(x, lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["kind"].alias("kind"), s["stop"].alias("stop")))


def base_spans(text: Column) -> Column:
    """The base spans by start, then kind."""
    return without_values(valued_base(text))


def valued_base(text: Column) -> Column:
    """The base spans with their texts, by start, then kind."""
    none = F.array().cast(VALUED)
    each = []
    for number, (kind, pattern, group, least) in enumerate(KINDS):
        each.append(F.when(text.rlike(QUICK[kind]), spans(text, LONG.get(kind, pattern), group, least, kind, number)).otherwise(none))
    return F.array_sort(F.concat(*each))


def listed(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def codes(run: Column) -> Column:
    """Places of a run's characters in the alphabet, from 0."""
    return F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def pairs(run: Column) -> Column:
    """Numbers of a run's neighbouring character pairs."""
    c = codes(run)
    n = F.size(c)
    return F.zip_with(F.slice(c, 1, n - 1), F.slice(c, 2, n - 1), lambda a, b: a * len(ALPHABET) + b)


def ratio(run: Column, table: list[float]) -> Column:
    """The greatest log-likelihood ratio of a stretch of a run, over its character pairs."""
    scores = F.lit(table)

    def step(acc: Column, k: Column) -> Column:
        here = F.greatest(acc["here"] + F.coalesce(F.get(scores, k), F.lit(0.0)), F.lit(0.0))
        return F.struct(here.alias("here"), F.greatest(acc["best"], here).alias("best"))

    start = F.struct(F.lit(0.0).alias("here"), F.lit(0.0).alias("best"))
    return F.aggregate(pairs(run), start, step, lambda acc: acc["best"])


def train(texts: DataFrame, sample: int) -> list[float] | None:
    """The log-likelihood ratio of each character pair. texts: rid, text."""
    marked = written(texts.select("rid", (F.size(base_spans(F.col("text"))) > 0).alias("has")), "marked")
    ids = marked.where("has").orderBy(F.xxhash64("rid"), "rid").limit(sample).union(marked.where("not has").orderBy(F.xxhash64("rid"), "rid").limit(sample))
    # ids are at most 2 * sample rows, and only their texts are scanned again
    rows = texts.join(F.broadcast(ids.select("rid").distinct()), "rid", "left_semi").withColumn("base", valued_base(F.col("text")))
    value = F.transform("base", lambda s: F.regexp_extract(s["value"], r"([A-Za-z0-9+/_.=-]+)$", 1))
    blanked = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), LONG["access"], " "), LONG["hex"], " ")
    plain = F.regexp_extract_all(blanked, F.lit(r"[A-Za-z0-9+/_.=-]{4,}"), F.lit(0))
    runs = rows.select(F.explode(F.array(F.struct(F.lit(True).alias("random"), value.alias("v")), F.struct(F.lit(False).alias("random"), plain.alias("v")))).alias("r")).select("r.random", F.explode("r.v").alias("v")).where("length(v) > 1")
    runs = runs.groupBy("random", "v").count().where("random or count > 1")
    n = len(ALPHABET)
    counts = {True: [0.0] * (n * n), False: [0.0] * (n * n)}
    for r in runs.select("random", F.explode(pairs(F.col("v"))).alias("k")).groupBy("random", "k").count().collect():
        counts[r["random"]][r["k"]] += r["count"]
    if not any(counts[True]):
        return None
    chance = {kind: conditional(c) for kind, c in counts.items()}
    return [math.log(chance[True][k]) - math.log(chance[False][k]) for k in range(n * n)]


def conditional(counts: list[float], weight: float = 8.0) -> list[float]:
    """Chance of each character after each other, drawn to the chance of the
    character alone where the pair's first character is rare."""
    n = len(ALPHABET)
    alone = [sum(counts[a * n + b] for a in range(n)) for b in range(n)]
    alone = [(x + 0.5) / (sum(alone) + 0.5 * n) for x in alone]
    after = [sum(counts[a * n : a * n + n]) for a in range(n)]
    return [(counts[a * n + b] + weight * alone[b]) / (after[a] + weight) for a in range(n) for b in range(n)]


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = 2000, odds: float = 1e6) -> DataFrame:
    """doc_id, text, base and added: arrays of spans (start, kind_no, kind, stop), and
    all: both by start, then kind."""
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    scores = train(texts.select(F.xxhash64("doc_id").alias("rid"), "text"), sample)
    found = texts.withColumn("base", base_spans(F.col("text")))
    none = F.array().cast(SPAN)
    if scores is None:
        return found.select("doc_id", "text", "base", none.alias("added"), F.col("base").alias("all"))
    high = lambda run: ratio(run, scores) > math.log(odds)
    # base spans as blanks: what stands beside them in a run is scored by itself
    found = found.withColumn("rest", substituted(F.col("text"), F.col("base"), lambda b, left: F.repeat(F.lit(" "), left)))
    found = found.withColumn("flagged", F.exists(F.regexp_extract_all("rest", F.lit(RUN), F.lit(0)), high))
    placed = F.filter(spans(F.col("rest"), RUN, 0, 16, "markov", len(KINDS)), lambda s: high(s["value"]))
    found = found.withColumn("added", F.when(F.col("flagged"), without_values(placed)).otherwise(none))
    return found.select("doc_id", "text", "base", "added", F.array_sort(F.concat("base", "added")).alias("all"))


def substituted(text: Column, every: Column, by) -> Column:
    """The text with each span replaced by by(span, how much of it is not yet replaced)."""

    n = F.length(text)

    def replaced(c: Column) -> Column:
        # c: the text in pieces of CHUNK code points, as taking a part of a long text or array costs its whole length
        def part(a: Column, b: Column) -> Column:
            first, last = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
            head = F.substring(F.get(c, first), a % CHUNK + 1, F.least(b - a, F.lit(CHUNK)))
            between = F.when(last > first + 1, F.array_join(F.slice(c, first + 2, F.greatest(last - first - 1, F.lit(0))), "")).otherwise("")
            return F.when(b <= a, "").when(first == last, head).otherwise(F.concat(head, between, F.substring(F.get(c, last), F.lit(1), (b - 1) % CHUNK + 1)))

        def step(acc: Column, s: Column) -> Column:
            full = F.size(acc["new"]) >= CHUNK
            new = F.when(full, F.array().cast("array<string>")).otherwise(acc["new"])
            out = F.when(full, F.concat(acc["out"], F.array(F.array_join(acc["new"], "")))).otherwise(acc["out"])
            more = F.concat(new, F.array(part(acc["at"], s["start"]), by(s, s["stop"] - F.greatest(acc["at"], s["start"]))))
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["stop"] > acc["at"], more).otherwise(new).alias("new"), out.alias("out"))

        none = F.array().cast("array<string>")
        start = F.struct(F.lit(0).alias("at"), none.alias("new"), none.alias("out"))
        return F.aggregate(every, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.array_join(acc["new"], ""), part(acc["at"], n)))

    # array of one element: binds the pieces to a name
    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))
    return F.when(F.size(every) > 0, F.get(F.transform(F.array(pieces), replaced), F.lit(0))).otherwise(text)


def redacted(text: Column, every: Column) -> Column:
    """The text with each span replaced by its kind in brackets (overlapping spans: that of the first)."""
    return substituted(text, every, lambda s, left: F.when(left == s["stop"] - s["start"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(""))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


QUERIES = {"op10_secrets": op10_secrets}
ORACLE_SQL: dict[str, str] = {}
