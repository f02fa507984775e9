"""The queries of this subpackage and their SQL."""

from seamline.llm import byte_bpe, chat, decontaminate, language_model, passages, quality_rules, ranked_search, resampling, secrets, shards, simhash, token_counts, warc

MODULES = (simhash, token_counts, decontaminate, shards, chat, warc, byte_bpe, passages, quality_rules, secrets, ranked_search, language_model, resampling)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
