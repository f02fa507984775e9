"""Importance resampling of documents towards a target distribution (operator 13).

A text is lower-cased (A-Z only) and cut into words by the tokenizers library's untrained
Regex Split, which gives each word with its offsets. Features are the windows of 1 to
`longest` consecutive words, joined by one space. With p(x) the CRC-32 of the first x bytes
of the words so joined, the CRC of the window of an offset pair (a, b) is p(b) xor p(a)
carried on over b - a zero bytes; so one running CRC over the words and array look-ups give
all windows' buckets, and no window's text is built.

1. One pass over the texts writes each document's buckets, two bytes a feature.
2. Histograms of the corpus (s, S) and of the target (t, T) are summed by task, then by
   bucket; a bucket's gain is floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))).
3. A document's weight is the sum of its features' gains, its score the weight plus Gumbel
   noise from a hash of its id; the highest scores are drawn, which samples without
   replacement in proportion to exp(weight / 1000). Ranks come from a range-partitioned
   sort and the partitions' row counts, so no task holds them all.

Null and empty texts have no features and weight 0. Null ids are hashed as an empty
string and come first among equal scores. Rows are kept one for one, repeated rows and
ids included; an empty table gives an empty result, an empty target gains that only
depend on the corpus. Texts and words may be of any length: texts are cut in pieces
between words. Columns beyond id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.shared import table, written

#: What words consist of, as a regular expression.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of a text that the splitter gets at once, and bytes of a window that tables serve.
PIECE, NEAR = 1 << 16, 256


@cache
def carry_tables() -> np.ndarray:
    """[n, k, x]: the CRC register with byte x at place k, carried on over n zero bytes."""
    one = np.array([zlib.crc32(bytes([x])) ^ zlib.crc32(b"\0") for x in range(256)], np.uint32)
    out = np.zeros((NEAR, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, NEAR):
        out[n] = one[out[n - 1] & 255] ^ (out[n - 1] >> np.uint32(8))
    return out


def carried(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC registers carried on over n zero bytes each (n below NEAR)."""
    t = carry_tables()
    return t[n, 0, crc & 255] ^ t[n, 1, crc >> 8 & 255] ^ t[n, 2, crc >> 16 & 255] ^ t[n, 3, crc >> 24]


@cache
def splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


#: A character that separates words.
GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def words_with_offsets(text: str) -> Iterator[list[tuple[str, tuple[int, int]]]]:
    """Words and their offsets in the lower-cased text, in pieces cut between words."""
    text, at = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "replace"), 0
    while at < len(text):
        cut = GAP.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield [(w, (a + at, b + at)) for w, (a, b) in splitter().pre_tokenize_str(text[at:end])] if at else splitter().pre_tokenize_str(text[at:end])
        at = end


def buckets_of(text: str, buckets: int, longest: int) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all windows of 1 to `longest` words."""
    before, after, starts, ends, parts = [], [], [], [], []
    crc, place, crc32 = 0, 0, zlib.crc32
    for piece in words_with_offsets(text):
        for w, _ in piece:
            b = w.encode()
            before.append(crc)
            starts.append(place)
            place += len(b)
            crc = crc32(b, crc)
            after.append(crc)
            ends.append(place)
            crc = crc32(b" ", crc)
            place += 1
            if len(b) >= NEAR // 4:
                parts.append((len(starts) - 1, b))
    p, q, a, e = (np.array(x, t) for x, t in ((before, np.uint32), (after, np.uint32), (starts, np.int64), (ends, np.int64)))
    n, out, long_words = len(a), [], dict(parts)
    for k in range(1, min(longest, n) + 1):
        length = e[k - 1 :] - a[: n - k + 1]
        far = np.flatnonzero(length >= NEAR)
        got = q[k - 1 :] ^ carried(p[: n - k + 1], np.where(length < NEAR, length, 0))
        for i in far:
            got[i] = window_crc(p, q, a, e, long_words, int(i), int(i) + k - 1)
        out.append(got % buckets)
    return n, np.concatenate(out).astype("<u2" if buckets <= 1 << 16 else "<u4") if out else np.array([], "<u2" if buckets <= 1 << 16 else "<u4")


def window_crc(p: np.ndarray, q: np.ndarray, a: np.ndarray, e: np.ndarray, long_words: dict[int, bytes], i: int, j: int) -> int:
    """The CRC of the window of words i to j, word by word: long words by their bytes, others by their offsets."""
    crc = 0
    for k in range(i, j + 1):
        if k > i:
            crc = zlib.crc32(b" ", crc)
        if k in long_words:
            crc = zlib.crc32(long_words[k], crc)
        else:
            n = np.array([e[k] - a[k]])
            crc = int(q[k] ^ carried(p[k : k + 1], n)[0] ^ carried(np.array([crc], np.uint32), n)[0])
    return crc


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", buckets: int = 10_000, longest: int = 3) -> DataFrame:
    """doc_id, n_words, n_features and the features' buckets as binary (16 bits each; 32 beyond 65,536 buckets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                got = [buckets_of(t or "", buckets, longest) for t in part.column("text").to_pylist()]
                columns = [part.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array([len(b) for _, b in got], pa.int64()), pa.array([b.tobytes() for _, b in got], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "buckets"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, buckets binary")


def flat(column: pa.Array, buckets: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, "<u2" if buckets <= 1 << 16 else "<u4") for b in column.to_pylist()] or [np.array([], np.uint16)])


def histogram(found: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: how many features fall into each; a row a task and bucket is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(flat(batch.column(0), buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket; `buckets` numbers come to the driver, whatever the input."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for into, of in ((s, corpus), (t, target)):
        for row in histogram(of, buckets).collect():
            into[row["bucket"]] = row["n"]
    above, below = (t + 1) * float(s.sum() + buckets), (s + 1) * float(t.sum() + buckets)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """found with weight in place of buckets: the sum of the gains of a document's features."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.append(0, np.cumsum(gain[flat(batch.column("buckets"), buckets)]))
            ends = np.append(0, np.cumsum(batch.column("n_features").to_numpy(zero_copy_only=False))).astype(np.int64)
            weight = pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), weight], ["doc_id", "n_words", "n_features", "weight"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(key: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel variate) from the SHA-256 of `seed:key`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank, from 1, in the given order: sorted in ranges, each range's first
    rank being the number of rows before it (a number a partition goes through the driver)."""
    at = F.monotonically_increasing_id()
    parts = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at), "ranges")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for row in parts.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((row["part"], before))
        before += row["count"]
    first = rows.sparkSession.createDataFrame(offsets, "part bigint, before bigint")
    return parts.join(F.broadcast(first), part == F.col("part")).withColumn("rank", F.col("before") + place + 1).drop("part", "before", "at")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000, longest: int = 3, id_column: str = "doc_id", text_column: str = "text", target_column: str = "text") -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; rank is null unless
    the document is drawn. Documents of fewer than `least_words` words are never drawn."""
    found = written(features(docs, id_column, text_column, buckets, longest), "feature-buckets")
    wanted = features(target.select(F.lit(0).alias("doc_id"), F.col(target_column).alias("text")), buckets=buckets, longest=longest)
    scored = weights(found, gains(found, wanted, buckets)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored, "scored")
    fit = F.col("n_words") >= least_words
    drawn = percent * scored.where(fit).count() // 100
    places = ranked(scored.where(fit), F.desc("score"), F.asc("doc_id"))
    rows = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("bigint")))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_resampling": op13_resampling}
#: CRC-32 of all windows is beyond SQL on whole tables; tests hold the query against brute force.
ORACLE_SQL: dict[str, str] = {}
