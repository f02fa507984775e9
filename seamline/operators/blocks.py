"""A stated set of queries against all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def against(rows: DataFrame, queries: DataFrame, query_id: str, most: int = 10_000) -> DataFrame:
    """Every row with every query: rows stream past the queries, which are counted and
    broadcast in blocks of about `most` by hash of query_id, as many as it takes."""
    parts = max(1, -(-queries.count() // most))
    block = F.pmod(F.xxhash64(query_id), F.lit(parts))
    return reduce(DataFrame.unionByName, (rows.join(F.broadcast(queries.where(block == p))) for p in range(parts)))
