"""Corpus pipeline: quality rules, near-duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with all
their columns; the last returns one row of token counts and digests per document.
Between stages the documents are a Parquet table in the shared folder.

Rows with null ids pass the stages like others, but as one document where a
stage decides by id. Rows with equal ids share the decision of their id. Empty
tables give empty results. Columns beyond doc_id and text are carried along;
n_chars, if there, is counted anew where a text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import byte_bpe, decontaminate, quality_rules, secrets, simhash
from seamline.llm.shared import table, written


#: Labelled documents that train the quality rules, those with the smallest hash of their id.
SAMPLE = 20_000


def whole(docs: DataFrame) -> DataFrame:
    """docs as (doc, text): all columns in one, and the text."""
    return docs.select(F.struct(*docs.columns).alias("doc"), "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base nor the learned decision list rejects."""
    labels = table(spark, sf_dir, "labels")
    # at most SAMPLE ids, so they are broadcast and no text is shuffled
    ids = labels.where("quality is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    labelled = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    stats = written(quality_rules.text_statistics(labelled), "labelled-statistics")
    rules = quality_rules.learn(stats, labels, SAMPLE)
    judged = quality_rules.judged(quality_rules.text_statistics(whole(docs), "doc", "text"), rules)
    return judged.where("kept").select("doc_id.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near-duplicates: five-word shingles,
    similarity 0.8 or more."""
    classes = simhash.similar_classes(docs)
    gone = written(classes.where("not (doc_id <=> component_id)").select(F.col("doc_id").alias("gone")).distinct(), "near-duplicates")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    leaks = written(found.select(F.col("doc_id").alias("leak")).distinct(), "leaks")
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("leak")), "left_anti")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets."""
    found = secrets.scan(whole(docs), "doc", "text")
    clean = found.select("doc_id", F.when(F.col("doc_id.text").isNotNull(), secrets.redacted(F.col("text"), F.col("all"))).alias("clean"))
    of = {"text": F.col("clean"), "n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return clean.select(*((of[c] if c in of else F.col("doc_id")[c]).alias(c) for c in docs.columns))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the decoded bytes, as counts and digests."""
    import public_tokenizers

    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("byte-level bpe", bpe_stage),
]

#: Learned rules, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
