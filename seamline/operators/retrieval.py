"""Hybrid search over text chunks: BM25Plus on character n-grams, cosine, soft filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions import geometry as G
from seamline.operators.blocks import against


def ngrams(text: Column) -> Column:
    """Character 2- and 3-grams; white-space runs count as one space, case is kept.
    Built from an array of characters, each step bound to a name, so the work is
    linear in the text."""

    def both(c: Column) -> Column:
        n = F.size(c)
        two = F.zip_with(F.slice(c, 1, F.greatest(n - 1, F.lit(0))), F.slice(c, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, b))
        three = lambda g: F.concat(g, F.zip_with(F.slice(g, 1, F.greatest(n - 2, F.lit(0))), F.slice(c, 3, F.greatest(n - 2, F.lit(0))), lambda a, b: F.concat(a, b)))
        return G.named(two, three)

    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    return G.named(F.split(t, ""), both)


def postings(chunks: DataFrame, id_column: str = "chunk_no") -> DataFrame:
    """term, id, tf: the inverted index. Terms are pre-counted beside the scan."""
    bound = chunks.select(id_column, F.explode_outer(F.array(ngrams(F.col("text")))).alias("grams"))
    return bound.select(id_column, F.explode_outer("grams").alias("term")).where("term is not null").groupBy(id_column, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(index: DataFrame, chunks: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, delta: float = 1.0, present_only: bool = False, id_column: str = "chunk_no") -> DataFrame:
    """query_id, id, bm for every chunk that shares a term with a query (the others
    have the same constant part only, which min-max scaling removes: see hybrid).

    The formula is the published BM25Plus with idf = ln((N + 1) / df). Common libraries
    add delta for every query term, present or not, so only the part that differs
    between chunks is summed; with present_only delta is added for the terms that a
    chunk has, as in the paper. A query's repeated terms count
    repeatedly. queries: query_id, text; broadcast after a check of their number.
    """
    lengths = chunks.select(id_column, F.size(ngrams(F.col("text"))).cast("bigint").alias("dl"))
    wanted = queries.select("query_id", F.explode(ngrams(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    return bm25_scores(index, lengths, wanted, k1, b, delta, present_only, id_column)


def bm25_scores(index: DataFrame, lengths: DataFrame, wanted: DataFrame, k1: float = 1.5, b: float = 0.75, delta: float = 1.0, present_only: bool = False, id_column: str = "chunk_no") -> DataFrame:
    """bm25() from postings (id, term, tf), chunk lengths (id, dl) and counted query terms
    (query_id, term, qtf)."""
    stats = lengths.agg(F.count(F.lit(1)).alias("docs"), F.sum("dl").alias("terms"))
    n = wanted.count()
    small = F.broadcast(wanted) if n <= 200_000 else wanted
    hits = index.join(small, "term")
    df = index.join(F.broadcast(wanted.select("term").distinct()) if n <= 200_000 else wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(df, "term").join(lengths, id_column).join(F.broadcast(stats))
    idf = F.log((F.col("docs") + 1) / F.col("df"))
    norm = k1 * (1 - b + b * F.col("dl") / (F.col("terms") / F.col("docs")))
    part = F.col("qtf") * idf * ((delta if present_only else 0.0) + F.col("tf") * (k1 + 1) / (norm + F.col("tf")))
    return rows.groupBy("query_id", id_column).agg(F.sum(part).alias("bm"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def scaled(scores: DataFrame, value: str, by: str = "query_id") -> DataFrame:
    """Min-max scaling over all rows of a query, by one aggregation joined back."""
    ends = scores.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return scores.join(ends, by).withColumn(value, (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)).drop("_lo", "_hi")


def hybrid(chunks: DataFrame, lexical: DataFrame, queries: DataFrame, weight: float = 0.6, id_column: str = "chunk_no") -> DataFrame:
    """All chunks against all queries, in blocks of queries: weight * cosine + (1 - weight)
    * scaled BM25; chunks without a shared term take part in the scaling with 0. A chunk
    without vector has cosine 0, and a query without one goes by BM25 alone."""
    pairs = against(chunks, queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
    both = pairs.join(lexical, ["query_id", id_column], "left").withColumn("bm", F.coalesce("bm", F.lit(0.0)))
    return scaled(both, "bm").withColumn("dense", cosine(F.col("embedding"), F.col("_q"))).withColumn("score", F.when(F.col("_q").isNull(), F.col("bm")).otherwise(weight * F.coalesce("dense", F.lit(0.0)) + (1 - weight) * F.col("bm"))).drop("_q")


def soft(score: Column, topics: list[str] | None = None, doc_types: list[str] | None = None, doc_ids: list | None = None) -> Column:
    """Soft filters: a mismatch scales the score and never removes a row; no list, no filter."""
    if topics:
        score = F.when(F.arrays_overlap("topics", F.array(*map(F.lit, topics))), score).otherwise(score * 0.5)
    if doc_types:
        score = F.when(F.col("doc_type").isin(doc_types), score).otherwise(score * 0.3)
    if doc_ids:
        score = F.when(F.col("doc_id").isin(doc_ids), score).otherwise(score * 0.3)
    return score


def context(hits: DataFrame) -> DataFrame:
    """One block of text per query from its ranked hits."""
    block = F.format_string('<source id="%d" cite="%s">%s</source>', F.col("rank"), F.col("citation"), F.col("text"))
    blocks = F.sort_array(F.collect_list(F.struct("rank", block.alias("b"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("context"))
