"""Queries: text chunks, retrieval, catalogue and dataset building."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seamline.operators import block_scores as B
from seamline.operators import chunking as C
from seamline.operators import dataset as D
from seamline.operators import retrieval as R
from seamline.operators import stored_index as X
from seamline.operators.blocks import against
from seamline.sources import files as S
from seamline.plans.proxies import table
from seamline.sources.tables import kept, work_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


NORM = r"regexp_replace(text, '\s+', ' ', 'g')"
GRAMS = f"list_concat([t[i:i + 1] for i in range(1, greatest(length(t), 1))], [t[i:i + 2] for i in range(1, greatest(length(t) - 1, 1))])"


@query(f"SELECT doc_id, len(g) AS n_grams, len(list_distinct(g)) AS n_distinct FROM (SELECT doc_id, {GRAMS} AS g FROM (SELECT doc_id, {NORM} AS t FROM documents))")
def char_ngrams(spark, sf):
    rows = B.bags(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", F.col("dl").alias("n_grams"), F.size("keys").cast("long").alias("n_distinct"))


#: Queries of the searches: the documents whose id is divisible by 100, against all.
def questions(spark, sf):
    return table(spark, sf, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")


def lexical(spark, sf, bags=None, **settings):
    """Chunks and queries with the parts of their BM25 weights; terms are counted once."""
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_no"), "text")
    counted = kept(B.bags(chunks, "chunk_no") if bags is None else bags, "bags")
    asking = kept(B.bags(questions(spark, sf), "query_id"), "query-bags")
    c, q = B.weighed(counted, asking, **settings)
    return c, kept(q, "queries")


V_BM25 = f"""v_t AS (SELECT doc_id AS chunk_no, unnest({GRAMS}) AS term FROM (SELECT doc_id, {NORM} AS t FROM documents)),
v_post AS (SELECT chunk_no, term, count(*) AS tf FROM v_t GROUP BY ALL), v_len AS (SELECT chunk_no, sum(tf) AS dl FROM v_post GROUP BY chunk_no),
v_n AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(dl) FROM v_len) AS terms),
v_q AS (SELECT query_id, unnest({GRAMS}) AS term FROM (SELECT doc_id AS query_id, {NORM} AS t FROM documents WHERE doc_id % 100 = 0)), v_qt AS (SELECT query_id, term, count(*) AS qtf FROM v_q GROUP BY ALL),
v_df AS (SELECT term, count(*) AS df FROM v_post GROUP BY term),
v_bm AS (SELECT query_id, chunk_no, sum(qtf * ln((docs + 1) / df::DOUBLE) * (tf * 2.5::DOUBLE / (1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (terms / docs::DOUBLE)) + tf))) AS bm FROM v_post JOIN v_qt USING (term) JOIN v_df USING (term) JOIN v_len USING (chunk_no), v_n GROUP BY ALL)"""


@query(f"WITH {V_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm, 6) DESC, chunk_no) AS rank FROM v_bm QUALIFY rank <= 5) SELECT query_id, chunk_no, rank::INT AS rank, round(bm, 4) AS bm FROM r")
def bm25_search(spark, sf):
    return top(B.best_bm25(*lexical(spark, sf), k=5), "bm")


@query(f"WITH {V_BM25.replace('* (tf * 2.5', '* (1.0::DOUBLE + tf * 2.5')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm, 6) DESC, chunk_no) AS rank FROM v_bm QUALIFY rank <= 5) SELECT query_id, chunk_no, rank::INT AS rank, round(bm, 4) AS bm FROM r")
def bm25_present_terms(spark, sf):
    return top(B.best_bm25(*lexical(spark, sf, present_only=True), k=5), "bm")


@query(ORACLE_SQL["bm25_search"])
def stored_bm25_search(spark, sf):
    """bm25_search from an index on disk: built from half of the documents, with an edition
    that replaces some, adds the others, and removes those that were never meant."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_no"), "text")
    path = f"{work_folder(spark)}/seamline-index-{uuid.uuid4().hex}"
    first = docs.where("chunk_no % 2 = 0").withColumn("text", F.when(F.col("chunk_no") % 10 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text")))
    never = docs.where("chunk_no % 50 = 7").select((-F.col("chunk_no") - 1).alias("chunk_no"), "text")
    X.build(path, first.unionByName(never))
    X.update(path, docs.where("chunk_no % 2 = 1 or chunk_no % 10 = 0"), never)
    return top(B.best_bm25(*lexical(spark, sf, X.bags(spark, path, questions(spark, sf))), k=5), "bm")


def top(scores, value: str, k: int = 5, digits: int = 6, shown: int = 4):
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round(value, digits)), "chunk_no"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "chunk_no", "rank", F.round(value, shown).alias(value))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_no"), "embedding")


def asked(spark, sf):
    return vectors(spark, sf).where("chunk_no % 100 = 0").select(F.col("chunk_no").alias("query_id"), "embedding")


V_DENSE = "v_dense AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_no, list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS dense FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)"


@query(f"WITH {V_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 6) DESC, chunk_no) AS rank FROM v_dense QUALIFY rank <= 5) SELECT query_id, chunk_no, rank::INT AS rank, round(dense, 4) AS dense FROM r")
def dense_search(spark, sf):
    q = asked(spark, sf)
    found = kept(B.best_cosine(vectors(spark, sf), q, k=5), "near-vectors")
    # queries with too few cosines also get chunks without one
    enough = found.groupBy("query_id").count().where("count >= 5")
    short = q.join(enough, "query_id", "left_anti").withColumnRenamed("embedding", "q")
    rest = against(vectors(spark, sf), short, "query_id").select("query_id", "chunk_no", R.cosine(F.col("embedding"), F.col("q")).alias("dense"))
    return top(found.join(enough, "query_id", "left_semi").unionByName(rest), "dense")


def fused(spark, sf, **filters):
    """All documents, with or without a vector, against the queries with their own vectors:
    the best by hybrid scores times the factors of soft filters."""
    meta = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_no"), "text", F.col("source").alias("doc_type"), F.array("lang").alias("topics"))
    chunks = meta.select("chunk_no", "text", R.soft(F.lit(1.0), **filters).alias("factor"))
    # texts meet their vectors before they are counted, as terms take more room than texts
    c, q = lexical(spark, sf, B.bags(chunks.join(vectors(spark, sf), "chunk_no", "left"), "chunk_no"))
    return B.best_hybrid(c, kept(q.join(asked(spark, sf), "query_id", "left"), "queries"), k=5)


V_FUSED = f"""{V_BM25}, v_pair AS (SELECT q.doc_id AS query_id, o.doc_id AS chunk_no, e.embedding IS NOT NULL AS asked, CASE WHEN e.embedding IS NULL OR c.embedding IS NULL THEN 0.0::DOUBLE ELSE list_cosine_similarity(c.embedding::DOUBLE[], e.embedding::DOUBLE[]) END AS dense, coalesce(bm, 0.0::DOUBLE) AS bm, o.lang, o.source
  FROM (SELECT doc_id FROM documents WHERE doc_id % 100 = 0) q CROSS JOIN documents o LEFT JOIN embeddings e ON e.vec_id = q.doc_id LEFT JOIN embeddings c ON c.vec_id = o.doc_id LEFT JOIN v_bm b ON b.query_id = q.doc_id AND b.chunk_no = o.doc_id),
v_end AS (SELECT query_id, min(bm) AS lo, max(bm) AS hi FROM v_pair GROUP BY query_id), v_fused AS (SELECT *, CASE WHEN asked THEN 0.6::DOUBLE * dense + 0.4::DOUBLE * ((bm - lo) / (hi - lo + 1e-9)) ELSE (bm - lo) / (hi - lo + 1e-9) END AS score FROM v_pair JOIN v_end USING (query_id))"""


def ranked_sql(score: str) -> str:
    return f"WITH {V_FUSED}, s AS (SELECT query_id, chunk_no, {score} AS score FROM v_fused), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_no) AS rank FROM s QUALIFY rank <= 5) SELECT query_id, chunk_no, rank::INT AS rank, round(score, 4) AS score FROM r"


@query(ranked_sql("score"))
def hybrid_search(spark, sf):
    return top(fused(spark, sf), "score")


@query(ranked_sql("score * CASE WHEN lang = 'de' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * CASE WHEN source IN ('src1', 'src2') THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END"))
def soft_filter_search(spark, sf):
    return top(fused(spark, sf, topics=["de"], doc_types=["src1", "src2"]), "score")


KEYS = {"articles": ["the ", "der ", "les "], "licence": ["Licensed", "License"], "digits": ["0", "1"], "pipe": ["|"]}
TAGS = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(text, {chr(39)}{k}{chr(39)})' for k in v)} THEN '{n}' END" for n, v in KEYS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({TAGS}, ',') AS topics FROM documents")
def topic_tags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(C.topics(F.col("text"), KEYS), ",").alias("topics"))


@query(f"SELECT topic, count(*) AS n FROM (SELECT unnest({TAGS}) AS topic FROM documents) GROUP BY topic")
def topic_distribution(spark, sf):
    return table(spark, sf, "documents").select(F.explode(C.topics(F.col("text"), KEYS)).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT min(t) AS least, median(t) AS middle, max(t) AS most, count(*) FILTER (t > 800) AS over FROM (SELECT floor(length(text) * 0.7::DOUBLE)::INT AS t FROM documents)")
def chunk_stats(spark, sf):
    t = table(spark, sf, "documents").select(C.tokens(F.col("text")).alias("t"))
    return t.agg(F.min("t").alias("least"), F.median("t").alias("middle"), F.max("t").alias("most"), F.count_if(F.col("t") > 800).alias("over"))


@query("SELECT doc_id, substr(sha1(concat_ws('|', source, lang, doc_id::VARCHAR, '0', substr(text, 1, 64))), 1, 16) AS chunk_id FROM documents")
def chunk_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.chunk_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string"), F.lit(0), F.col("text")).alias("chunk_id"))


#: An article's title and body that stand on one line, and nine lines of which the last is a head too late to be one.
TITLE, BODY = "101. 적용 (2026)", "이 장의 규정은 용접 이음부의 비파괴 검사에 적용하며 그 밖의 사항은 따로 정한다."
TAIL = ["x"] * 8 + ["2편"]


@query(rf"""WITH l AS (SELECT doc_id, list_concat(CASE WHEN doc_id % 4 = 2 THEN ['{TITLE}', '{BODY}'] ELSE []::VARCHAR[] END, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '\S')), CASE WHEN doc_id % 3 = 0 THEN {TAIL} ELSE []::VARCHAR[] END) AS l FROM documents)
SELECT doc_id, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS lines FROM l""")
def header_strip(spark, sf):
    """Pages that start with a running head, an article's title and body on one line, or neither; some have late heads."""
    k = F.col("doc_id")
    first = F.when(k % 4 == 0, "2편재료").when(k % 4 == 1, "  선급 및 강선규칙 적용지침 2026 ").when(k % 4 == 2, f"{TITLE} {BODY}")
    page = F.concat_ws("\n", first, "text", F.when(k % 3 == 0, "\n".join(TAIL)))
    lines = table(spark, sf, "documents").select("doc_id", C.body_lines(page).alias("l"))
    return lines.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("lines"))


@query()
def paragraph_pack(spark, sf):
    groups = table(spark, sf, "documents").select("doc_id", C.packed(C.paragraphs(F.split("text", "\n"), 200), 200).alias("g"))
    return groups.select("doc_id", F.size("g").alias("n_groups"), F.size(F.flatten("g")).alias("n_paragraphs"))


def rule_pages(spark, sf):
    """Regulation-like pages around benchmark texts."""
    i = F.col("item_id")
    text = F.concat(F.lit("제 "), (i % 3 + 1).cast("string"), F.lit(" 장 총칙\n제 1 절 일반\n"), (i + 101).cast("string"), F.lit(". 적용 (2021)\n1. "), F.regexp_replace("text", "\\s+", " "), F.lit("\n(1) "), F.regexp_replace("text", "\\s+", " "))
    return table(spark, sf, "benchmark").select((i % 4).cast("string").alias("doc_id"), (F.floor(i / 4) + 1).cast("int").alias("page_no"), text.alias("text"))


@query()
def structure_parse(spark, sf):
    return C.structured(rule_pages(spark, sf)).withColumn("lines", F.size("lines"))


@query()
def regulation_chunks(spark, sf):
    return C.chunks(C.structured(rule_pages(spark, sf)), {"title": "Rules", "edition": "2025", "short": "R", "part": "2", "part_title": "materials"}, 60).drop("topics")


@query("SELECT p_type AS class, count(*) AS n, count(*) FILTER (w = 1280 AND h = 720) AS tiles, round(avg(w), 4) AS mean_width, round(avg(h), 4) AS mean_height, round(avg(w / h::DOUBLE), 4) AS mean_aspect, round(count(*) FILTER (w = 1280 AND h = 720) / count(*)::DOUBLE, 3) AS tile_ratio FROM (SELECT p_type, p_size % 3 * 640 + 1280 AS w, p_size % 3 * 100 + 720 AS h FROM part) GROUP BY p_type")
def leakage_report(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_type").alias("class"), (F.col("p_size") % 3 * 640 + 1280).alias("width"), (F.col("p_size") % 3 * 100 + 720).alias("height"))
    return D.leakage(D.with_shape(rows))


@query("SELECT o_orderpriority AS class, CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM orders GROUP BY ALL")
def class_split_counts(spark, sf):
    return D.by_class_and_split(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("class"), F.when(F.col("o_orderkey") % 10 < 8, "train").otherwise("val").alias("split")))


@query("SELECT doc_id, 'no label' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT vec_id, 'no image' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def anti_join_verify(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    labels = table(spark, sf, "labels").select("doc_id").union(table(spark, sf, "embeddings").select("vec_id").join(docs, F.col("vec_id") == docs.doc_id, "left_anti"))
    return D.unmatched(docs, labels, "doc_id")


@query("""WITH l AS (SELECT vec_id, '0 ' || array_to_string([(round(embedding[i]::DOUBLE + 0.4, 4))::VARCHAR for i in range(1, 64 + vec_id % 2)], ' ') AS line, len(list_filter(embedding[1:63 + vec_id % 2], lambda v: round(v::DOUBLE + 0.4, 4) < 0 OR round(v::DOUBLE + 0.4, 4) > 1)) AS out FROM embeddings)
SELECT count(*) AS files, 0::BIGINT AS empty, count(*) FILTER (vec_id % 2 = 0) AS bad_lines, count(*) FILTER (vec_id % 2 = 1 AND out > 0) AS out_of_range FROM l""")
def label_grammar(spark, sf):
    n = (F.lit(63) + F.col("vec_id") % 2).cast("int")
    line = F.concat(F.lit("0 "), F.array_join(F.transform(F.slice("embedding", F.lit(1), n), lambda v: F.round(v.cast("double") + 0.4, 4).cast("string")), " "))
    return D.verified(table(spark, sf, "embeddings").select(F.col("vec_id").alias("stem"), line.alias("text")))


@query("""WITH r AS (SELECT p_partkey AS label_id, p_size % 20 = 0 AS is_tile, md5('42:' || p_partkey) AS h FROM part), n AS (SELECT 100 - least(100, count(*)) AS rest FROM r WHERE is_tile),
c AS (SELECT least((SELECT count(*) FROM r WHERE NOT is_tile), (rest + 1) // 2) AS n, rest FROM n), t AS (SELECT label_id, is_tile, 0 AS crops FROM r WHERE is_tile ORDER BY h, label_id LIMIT 100),
p AS (SELECT *, row_number() OVER (ORDER BY h, label_id) - 1 AS k FROM r WHERE NOT is_tile)
SELECT * FROM t UNION ALL SELECT label_id, is_tile, (rest // n + CASE WHEN k < rest % n THEN 1 ELSE 0 END)::INT FROM p, c WHERE n > 0 AND k < n""")
def negative_quota(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("label_id"), (F.col("p_size") % 20 == 0).alias("is_tile"), F.lit(True).alias("croppable"))
    return D.negatives(rows, 100).select("label_id", "is_tile", "crops")


@query("""SELECT doc_id AS stem, quality AS label, toxic AS split, row_number() OVER (PARTITION BY toxic, quality ORDER BY md5('42:' || doc_id), doc_id)::INT AS place FROM labels QUALIFY place <= 20""")
def balanced_subset(spark, sf):
    return D.balanced(table(spark, sf, "labels").select(F.col("doc_id").alias("stem"), F.col("quality").alias("label"), F.col("toxic").alias("split")), 20)


@query("SELECT 'k' AS key, 'integer' AS kind, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_props(spark, sf):
    return S.json_keys(table(spark, sf, "events"), "props")


@query("SELECT origin, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY origin")
def union_sources(spark, sf):
    part = lambda n: table(spark, sf, n).select(F.lit(n).alias("origin"), "text")
    return part("documents").unionByName(part("benchmark")).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT (SELECT count(*) FROM documents) AS n_chunks, string_agg(lang || '/' || source, ' ' ORDER BY lang, source) AS documents, 700 AS max_tokens FROM (SELECT DISTINCT lang, source FROM documents)")
def chunk_manifest(spark, sf):
    m = S.manifest(table(spark, sf, "documents").select(F.col("lang").alias("doc_id"), F.col("source").alias("edition")), {"max_tokens": 700})
    return m.select("n_chunks", F.array_join(F.transform("documents", lambda d: F.concat(d["doc_id"], F.lit("/"), d["edition"])), " ").alias("documents"), "max_tokens")
