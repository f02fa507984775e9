"""Regulation sources: selection, their tables, pages, editions, candidates to cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.operators.order import numbered

# The table left out of exports (visual inspection).
VISUAL_TABLE = "표12"


def selected_nodes(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes (source, doc_id, chapter, doc_type) of sources (source, skip, chapters,
    doc_types, guidance_doc_id) that are not skipped, in the chapters and types that the
    source asks for (null: all); guidance goes by the source's own id for it."""
    rows = nodes.join(sources.where("not coalesce(skip, false)"), "source")
    asked = lambda wanted, c: F.when(F.size(wanted) > 0, F.array_contains(wanted, F.col(c))).otherwise(True)
    rows = rows.where(asked("chapters", "chapter") & asked("doc_types", "doc_type"))
    guided = (F.col("doc_type") == "guidance") & (F.col("guidance_doc_id") != "")
    return rows.withColumn("doc_id", F.when(guided, F.col("guidance_doc_id")).otherwise(F.col("doc_id"))).select(*nodes.columns)


def source_tables(sources: DataFrame) -> DataFrame:
    """source, table_id of all tables of all sources, skipped ones included."""
    return sources.select("source", F.explode("tables").alias("table_id"))


def exported_tables(tables: DataFrame) -> DataFrame:
    return tables.where(F.col("table_id") != VISUAL_TABLE)


def pages(texts: DataFrame, text: str = "text") -> DataFrame:
    """A row per page of texts whose pages are parted by form feeds, numbered from 1."""
    keep = [c for c in texts.columns if c != text]
    return texts.select(*keep, F.posexplode(F.split(text, "\f")).alias("page", text)).withColumn("page", F.col("page") + 1)


def edition_changes(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Ids that only one edition has. Ids follow from the content, so a changed article
    is one removed and one added; both editions meet in one shuffle."""
    side = lambda df, was: df.select(key, F.lit(was).alias("was"))
    met = side(old, True).unionByName(side(new, False)).groupBy(key).agg(F.bool_or("was").alias("before"), F.bool_or(~F.col("was")).alias("after"))
    return met.where("before <> after").select(key, F.when(F.col("before"), "removed").otherwise("added").alias("change"))


def on_page(chunk: Column, page: Column) -> Column:
    """Whether the page has the first 15 characters, white space apart, of the chunk's body
    (30 characters from its second line on)."""
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    probe = F.substring(bare(F.substring(chunk, F.instr(chunk, "\n") + 1, F.lit(30))), 1, 15)
    return F.contains(bare(page), probe)


def article_counts(chunks: DataFrame, *by: str, order: str = "chunk_no") -> DataFrame:
    """Chunks of each article with the place where it is first seen."""
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))


def candidates(clauses: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Clauses (clause, topics) to cite for each class of wanted (its topics): those that
    share a topic, or all where none does; with the weight 1 / place ** 0.75 in the
    order of clauses. Classes are settings; places come from one numbering over all."""
    classes = F.array(*(F.struct(F.lit(k).alias("cls"), F.array(*map(F.lit, v)).alias("wanted")) for k, v in wanted.items()))
    rows = clauses.select("clause", "topics", F.explode(classes).alias("c")).select("clause", "c.cls", F.coalesce(F.arrays_overlap("topics", "c.wanted"), F.lit(False)).alias("hit"))
    rows = rows.join(rows.groupBy("cls").agg(F.bool_or("hit").alias("any")), "cls").where("hit or not any")
    placed = numbered(rows.select("cls", "clause"), F.asc("cls"), F.asc("clause"))
    first = placed.groupBy("cls").agg((F.min("place") - 1).alias("before"))
    placed = placed.join(F.broadcast(first), "cls").select("cls", "clause", (F.col("place") - F.col("before")).cast("int").alias("place"))
    return placed.withColumn("weight", F.round(F.pow("place", F.lit(-0.75)), 6))
