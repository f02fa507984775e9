"""Benchmark decontamination by SimHash of item-sized windows (operator 3).

Texts are lower-cased words; a shingle is five of them (fewer words: the whole
text). A document is contaminated by an item if one of its windows of the
item's length has a weighted (multiset) Jaccard similarity of `similarity` or
more with the item's shingles.

1. One pass over all shingles of all documents, joined to the index of item
   shingles, gives the places that items of a length share. All windows of that
   length that hold enough of them, at any places and in any order, are looked
   at: a similar window shares at least `similarity` times its item's shingles.
   The index has rows of 12 bytes and is broadcast if it has at most
   `broadcast_rows` of them, else shuffled.
2. Windows get a 64-bit SimHash, by one aggregation over their shingles; so do
   items. Both are cut into errors + 1 blocks of bits; two fingerprints within
   `errors` bits agree on a block, so the join on (length, block number, block)
   finds all of them; a pair counts at its first equal block. 24 bits are far out
   in the tail for a similarity of 0.8 (mean 10, deviation 3); blocks of so wide a
   radius have 2 or 3 bits and select little, so step 1 does most of the work.
3. The pairs are verified by exact similarity.

Spark functions only. Texts of documents are never shuffled in step 1; for step
2 the documents with windows are read again, found by a key of eight bytes that is
broadcast if at most `broadcast_rows` documents have windows, else joined.

Null and empty texts have no shingles and are never contaminated; items without
words are ignored, and items of fewer than five words only meet documents of
the same words; repeated items each report. Rows with equal ids are looked at one
by one, and the best window of all counts; null ids are one such id. Windows are
clipped at the document's ends. Texts may be of any length: a window holds its
own shingles only. Extra columns are ignored, whatever their names; empty tables
give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.shared import table, words, written

BITS = 64


def shingle_hashes(w: Column, size: int) -> Column:
    """Hashes of the word shingles of an array of words: each word is hashed once."""
    n = F.size(w)

    def every(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - size, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))

    # array of one element: binds the word hashes to a name
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.get(F.transform(F.array(F.transform(w, lambda x: F.xxhash64(x))), every), F.lit(0)))


def with_fingerprints(rows: DataFrame) -> DataFrame:
    """rows with fp: the 64-bit SimHash of h (bits set in over half of the hashes), by one
    aggregation over the hashes of each row."""
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "windows")
    ones = [F.count_if(F.getbit("x", F.lit(b)) == 1).alias(f"b{b}") for b in range(BITS)]
    counts = rows.select("row", F.explode("h").alias("x")).groupBy("row").agg(F.count("*").alias("n"), *ones)
    fp = F.lit(0).cast("bigint")
    for b in range(BITS):
        one = (1 << b) - (1 << BITS if b == BITS - 1 else 0)
        fp = fp.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("n"), F.lit(one)).otherwise(0).cast("bigint"))
    return written(rows.join(counts.select("row", fp.alias("fp")), "row").drop("row"), "fingerprints")


def cuts(errors: int) -> list[tuple[int, int]]:
    """(shift, mask) of the errors + 1 blocks of a fingerprint."""
    ends = [BITS * k // (errors + 1) for k in range(errors + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(ends, ends[1:])]


def blocks(df: DataFrame, errors: int) -> DataFrame:
    """df with a row for each block of fp: its number and bits."""
    each = F.array(*(F.struct(F.lit(k).alias("no"), F.shiftrightunsigned("fp", a).bitwiseAND(mask).cast("int").alias("bits")) for k, (a, mask) in enumerate(cuts(errors))))
    return df.select("*", F.explode(each).alias("b")).select(*df.columns, "b.*")


def first_equal(x: Column, errors: int) -> Column:
    """The number of the first block without a differing bit (x: the differing bits)."""
    return F.coalesce(*(F.when(F.shiftrightunsigned(x, a).bitwiseAND(mask) == 0, k) for k, (a, mask) in enumerate(cuts(errors))))


def window_starts(at: Column, places: Column, similarity: float) -> Column:
    """All starts of windows of `places` shingles that hold enough of the places `at`
    (sorted) for the similarity: two multisets, one of them of `places`, share
    similarity * places or more; windows at a text's start are clipped there."""
    need = F.greatest(F.ceil(similarity * places - 1e-9).cast("int"), F.lit(1))
    n = F.size(at)

    def around(i: Column) -> Column:
        first, last = F.get(at, i), F.get(at, i + need - 1)
        low = F.greatest(last - places + 1, F.lit(0))
        return F.when(low <= first, F.sequence(low, F.greatest(low, first))).otherwise(F.array().cast("array<int>"))

    return F.when(n >= need, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - need, F.lit(0))), around)))).otherwise(F.array().cast("array<int>"))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as multisets, by one walk over both, sorted."""
    tagged = F.array_sort(F.concat(F.transform(a, lambda x: F.struct(x.alias("h"), F.lit(1).alias("a"))), F.transform(b, lambda x: F.struct(x.alias("h"), F.lit(0).alias("a")))))
    start = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("both"))

    def step(acc: Column, x: Column) -> Column:
        same = acc["h"].eqNullSafe(x["h"])
        return F.struct(
            x["h"].alias("h"),
            (F.when(same, acc["a"]).otherwise(0) + x["a"]).alias("a"),
            (F.when(same, acc["b"]).otherwise(0) + 1 - x["a"]).alias("b"),
            (acc["both"] + F.when(same, 0).otherwise(F.least(acc["a"], acc["b"]))).alias("both"),
        )

    both = F.aggregate(tagged, start, step, lambda acc: acc["both"] + F.least(acc["a"], acc["b"]))
    return both / (F.size(a) + F.size(b) - both)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", size: int = 5, similarity: float = 0.8, errors: int = 24, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window of each
    contaminated document for each item (of equal ones, the first)."""
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    places = F.greatest(F.col("n_words") - (size - 1), F.lit(1))
    items = benchmark.select(F.col(item_column).alias("item_id"), words(F.lower(text_column)).alias("w")).where("size(w) > 0")
    items = with_fingerprints(items.select("item_id", F.size("w").alias("n_words"), shingle_hashes(F.col("w"), size).alias("h")))
    index = written(items.select(F.explode("h").alias("h"), "n_words").distinct(), "item-index")
    # rows of equal id and text are one
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    hashed = lambda df: df.select("doc_id", "key", shingle_hashes(words(F.lower("text")), size).alias("h"))
    # outer: else Spark infers a filter on h and computes it inside its own lambda, once per word
    spread = hashed(texts).select("key", F.posexplode_outer("h").alias("at", "h"))
    hits = spread.join(small(index), "h").groupBy("key", "n_words").agg(F.array_sort(F.collect_set("at")).alias("at"))
    starts = hits.select("key", "n_words", window_starts(F.col("at"), places, similarity).alias("starts")).where("size(starts) > 0")
    starts = written(starts.groupBy("key").agg(F.collect_list(F.struct("n_words", "starts")).alias("of")), "starts")
    read = written(hashed(texts.join(small(starts.select("key")), "key", "left_semi")).distinct(), "documents-with-windows")
    # each window takes its own shingles with it, not those of its text
    each = F.flatten(F.transform("of", lambda o: F.transform(o["starts"], lambda x: F.struct(o["n_words"].alias("n_words"), x.alias("start"), F.slice("h", x + 1, F.greatest(o["n_words"] - (size - 1), F.lit(1))).alias("h")))))
    windows = with_fingerprints(read.join(starts, "key").select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*"))
    of_items = written(blocks(items.select("n_words", "fp").distinct(), errors).withColumnRenamed("fp", "item_fp"), "item-blocks")
    # equal fingerprints meet once, and a pair counts at its first equal block
    near = blocks(windows.select("n_words", "fp").distinct(), errors).join(small(of_items), ["n_words", "no", "bits"])
    differing = F.col("fp").bitwiseXOR(F.col("item_fp"))
    near = near.where((F.bit_count(differing) <= errors) & (first_equal(differing, errors) == F.col("no"))).select("n_words", "fp", "item_fp")
    pairs = windows.join(near, ["n_words", "fp"]).join(items.select("item_id", "n_words", F.col("fp").alias("item_fp"), F.col("h").alias("item_h")), ["n_words", "item_fp"])
    # no more can be shared than distinct shingles allow; the exact figure only for the rest
    some = F.size(F.array_intersect("h", "item_h")) + (F.size("h") - F.size(F.array_distinct("h")))
    likely = pairs.where(some * (1 + similarity) >= similarity * (F.size("h") + F.size("item_h")) - 1e-9)
    found = likely.withColumn("similarity", weighted_similarity(F.col("h"), F.col("item_h"))).where(F.col("similarity") >= similarity)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.back")).cast("long").alias("start_word"), F.col("x.n_words").cast("long").alias("n_words"), F.round("x.similarity", 6).alias("similarity"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
#: The same by exact similarity of all windows that touch a shared shingle, without fingerprints.
ORACLE_SQL = {
    "op3_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, u.i - 1 AS pos, array_to_string(w[u.i:u.i + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
bs AS (SELECT item_id, len(w) AS n_words, greatest(len(w) - 4, 1) AS places, array_to_string(w[u.i:u.i + 4], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
bn AS (SELECT item_id, n_words, places, s, count(*) AS n FROM bs GROUP BY ALL),
hit AS (SELECT doc_id, item_id, places, pos FROM ds JOIN bn USING (s)),
enough AS (SELECT doc_id, item_id FROM hit GROUP BY ALL HAVING count(*) >= 0.8 * min(places) - 1e-9),
c AS (SELECT DISTINCT doc_id, item_id, places, u.i AS start FROM hit JOIN enough USING (doc_id, item_id), unnest(range(greatest(pos - places + 1, 0), pos + 1)) AS u(i)),
ws AS (SELECT c.doc_id, c.item_id, c.start, ds.s, count(*) AS n FROM c JOIN ds ON ds.doc_id = c.doc_id AND ds.pos >= c.start AND ds.pos < c.start + c.places GROUP BY ALL),
size AS (SELECT doc_id, item_id, start, sum(n) AS n FROM ws GROUP BY ALL),
inter AS (SELECT ws.doc_id, ws.item_id, ws.start, bn.n_words, bn.places, sum(least(ws.n, bn.n)) AS shared FROM ws JOIN bn ON bn.item_id = ws.item_id AND bn.s = ws.s GROUP BY ALL),
sim AS (SELECT i.doc_id, i.item_id, i.start, i.n_words, shared / (size.n + places - shared)::DOUBLE AS similarity FROM inter i JOIN size USING (doc_id, item_id, start))
SELECT doc_id, item_id, start::BIGINT AS start_word, n_words::BIGINT AS n_words, round(similarity, 6) AS similarity FROM sim
WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
}
