"""Uniform sharding by a hypergeometric communication matrix (operator 4).

Law `rows`: shard sizes differ by at most one row. Every assignment of rows to
shards with these sizes, and every order inside a shard, is equally likely:

1. the partitions of the input are counted (rows are numbered once, in a table in
   the shared folder, so a lost executor cannot change the numbering);
2. the matrix of how many rows each partition sends to each shard is drawn exactly,
   from multivariate hypergeometric distributions, by halving the partitions: a
   node of the tree holds how many rows of each shard come from its partitions,
   and is dealt to its two halves. Each node has a generator of its own number, so
   every task draws the nodes above its own partitions by itself. The driver only
   holds the counts of rows (a number for each partition);
3. in each partition, rows are put in random order and dealt out by the matrix;
4. after the exchange each shard is put in random order: by a second random
   key, in buckets of its range that are ranked apart and offset by the counts
   of the buckets before, so no task holds a shard.

Rows with equal keys differ by their number, so ties do not matter. Equal texts
are not kept together (a group may be larger than a shard). Null texts have
size 8 and the checksum of the empty string; texts of any length only add to a sum;
repeated and null ids stay rows of their own; an empty table gives an empty
result; extra columns are ignored by the query and kept by sharded(), where those
named shard or slot are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.llm.shared import table, written

TWO_PI = Decimal("6.28318530717958647692528676655900576839433879875021164194988918")


def log_factorial(n: int) -> Decimal:
    """By Stirling's series, to 30 digits behind the point."""
    if n < 1000:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    return x * x.ln() - x + (TWO_PI * x).ln() / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn without replacement are good. Populations beyond the library's
    range are drawn by the ratio of uniforms (Stadlober 1989), exactly up to 30 digits of
    the logarithm of a chance."""
    total = good + bad
    if not 0 <= n <= total:
        raise ValueError("more rows are drawn than there are")
    if n == 0 or good == 0 or bad == 0 or n == total:
        return min(n, good)
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    # the smaller kind in the smaller sample, and from it back
    kind, sample = min(good, bad), min(n, total - n)
    with localcontext() as c:
        c.prec = 60
        share = Decimal(kind) / total
        mean = sample * share
        width = ((total - sample) * sample * share * (1 - share) / (total - 1) + Decimal("0.5")).sqrt()
        e = Decimal(1).exp()
        hat = 2 * (2 / e).sqrt() * width + 3 - 2 * (3 / e).sqrt()
        others = total - kind - sample
        chance = lambda k: -sum(map(log_factorial, (k, kind - k, sample - k, others + k)))
        top = chance((sample + 1) * (kind + 1) // (total + 2))
        while True:
            u, v = (Decimal(int(x)) / (1 << 63) for x in rng.integers(1, 1 << 63, 2))
            k = int((mean + Decimal("0.5") + hat * (v - Decimal("0.5")) / u).to_integral_value("ROUND_FLOOR"))
            if not max(0, -others) <= k <= min(kind, sample):
                continue
            if 2 * u.ln() <= chance(k) - top:
                break
    k = k if kind == good else sample - k
    return k if sample == n else good - k


def dealt_out(rng: np.random.Generator, shards: tuple[int, ...], n: int) -> tuple[int, ...]:
    """How many of n rows drawn from all are of each shard."""
    out, rest = [], sum(shards)
    for free in shards:
        k = hypergeometric(rng, free, rest - free, n)
        out.append(k)
        rest, n = rest - free, n - k
    return tuple(out)


class Tree:
    """The matrix, drawn from the top as far as asked for. before: rows in the partitions
    before each one, and in all."""

    def __init__(self, before: np.ndarray, shards: int, seed: int) -> None:
        self.before, self.seed = before, seed
        total = int(before[-1])
        sizes = np.array([(total + shards - 1 - s) // shards for s in range(shards)], np.int64)
        # which shards get the odd rows
        self.root = tuple(np.random.default_rng([seed]).permutation(sizes).tolist())
        self.known: dict[tuple[int, int], tuple[int, ...]] = {}

    def row(self, p: int) -> tuple[int, ...]:
        """How many rows partition p sends to each shard."""
        lo, hi, here = 0, len(self.before) - 1, self.root
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if (lo, hi) not in self.known:
                if len(self.known) > 10_000:
                    self.known.clear()
                n = int(self.before[mid] - self.before[lo])
                self.known[lo, hi] = dealt_out(np.random.default_rng([self.seed, lo, hi]), here, n)
            left = self.known[lo, hi]
            lo, hi, here = (lo, mid, left) if p < mid else (mid, hi, tuple(a - b for a, b in zip(here, left)))
        return here


def sharded(rows: DataFrame, shards: int = 24, seed: int = 7, bucket_rows: int = 100_000) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    rows = rows.drop("shard", "slot")
    held = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_in"))
    numbered = written(held.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "numbered")
    counted = written(numbered.groupBy("_part").count(), "partition-counts")
    counts = sorted((r["_part"], r["count"]) for r in counted.collect())  # a row for each partition
    place = {p: k for k, (p, _) in enumerate(counts)}
    before = np.append(0, np.cumsum([n for _, n in counts])).astype(np.int64)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(before, shards, seed)
        for batch in batches:
            parts = batch.column("_part").to_pylist()
            to = np.cumsum([tree.row(place[p]) for p in parts], axis=1).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(parts) + 1) * shards).astype(np.int32)), pa.array(to.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("_part"), lists], ["_part", "_to"])

    # a partition's dealing: up to which rank its rows go to each shard
    deal = counted.select("_part").sort("_part").mapInArrow(draw, "_part int, _to array<long>")
    key = lambda n: F.xxhash64(F.lit(seed * 2 + n), "_row")
    dealt = numbered.withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(key(0), "_row")) - 1)
    dealt = dealt.join(deal, "_part").withColumn("shard", F.size(F.filter("_to", lambda to: to <= F.col("_rank"))))
    buckets = max(1, int(before[-1]) // (shards * bucket_rows) * 2)
    dealt = dealt.withColumn("_key", key(1)).withColumn("_bucket", F.shiftrightunsigned("_key", 33) * buckets / F.lit(1 << 31)).withColumn("_bucket", F.floor("_bucket").cast("int"))
    dealt = written(dealt.select("_in", "_row", "shard", "_key", "_bucket"), "dealt")
    sizes = dealt.groupBy("shard", "_bucket").count()
    before_it = sizes.withColumn("_before", F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.row_number().over(W.partitionBy("shard", "_bucket").orderBy(F.shiftleft("_key", 31), "_key", "_row")) - 1
    slots = dealt.withColumn("_rank", rank).join(before_it, ["shard", "_bucket"])
    return slots.select("_in.*", "shard", (F.col("_rank") + F.col("_before")).cast("long").alias("slot"))


def assigned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = 24, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = sharded(rows, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(table(spark, sf_dir, "documents"))


QUERIES = {"op4_shards": op4_shards}
ORACLE_SQL: dict[str, str] = {}
