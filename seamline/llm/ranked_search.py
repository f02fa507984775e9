"""Ranked lexical search with per-term geometric blocking (operator 11).

Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A term t
of a document of n terms has the value v = (10^9 tf) div (1000 tf + 8 m) with
m = 100 - 75 + (75 n N) div L, a document's score for an item is the sum of w(t) v over the
item's terms, repeats included; all in 64-bit integers.

1. `vectors`: one pass over all texts counts each document's terms, as far as an item asks
   for them; N, L and df follow.
2. `index`: documents are taken in shards, as many as stand together in a partition, so
   nothing is shuffled and no frequent term or group of copies gathers in one place. In
   each shard every term's posting list is clustered by document similarity: documents have
   a random projection of their weighted vectors, and each one of a list goes to the nearest
   of the list's evenly spaced leaders; clusters are cut into blocks of `block` documents.
   A block keeps the largest value of each term that an item holds beside the list's own
   (its summary).
3. `search`: an item's lists are visited from the rarest term to the most frequent. A
   document counts in the first list of the item's terms that holds it, so in a list
   only terms from there on can add to its score, and the summary times the item's
   weights bounds the scores of a block. A block is skipped only if its bound is below the
   k-th best score so far; all other documents are scored exactly. Each task gives its k
   best rows of each item; the best of those are the result.

Bounds are exact sums of integers in doubles as long as they are below 2^53, and are
widened by a share of 2^-40 beyond. Items are searched in groups whose terms together
number `together` at most (or of one item), so what tasks are sent is bounded; items of
over `wide` different terms have no summaries, so nothing is skipped for them.

Null and empty texts have no terms and are never found; items without terms have no
rows; repeated items, and those of null id, each have their own rows. Documents of equal
score come by ascending id, null ids last; rows of equal id are ranked one by one. Empty tables give an empty result; other columns are
ignored, whatever their names. Texts may be of any length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.llm.shared import erased, table, written

#: A term in UTF-8 bytes: letters, digits and all beyond ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Documents of a shard at most, of a block, numbers of a projection.
SHARD, BLOCK, SKETCH = 8192, 64, 32
#: Items of more different terms are held against all documents of their lists.
WIDE = 1024
NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass
class Items:
    """Items as rows of (term, times); vocabulary: their terms, numbered."""

    ids: list
    rows: list[Counter]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, found: list[tuple]) -> Items:
        kept = [(i, c) for i, text in found if (c := Counter(terms_of(text)))]
        vocabulary = {t: k for k, t in enumerate(sorted(set().union(*(c for _, c in kept))))}
        return cls([i for i, _ in kept], [Counter({vocabulary[t]: n for t, n in c.items()}) for _, c in kept], vocabulary)


def groups(items: DataFrame, id_column: str, text_column: str, together: int) -> Iterator[Items]:
    """The items, streamed to the driver and gathered up to `together` distinct terms a group."""
    now, size = [], 0
    for row in items.select(F.col(id_column).alias("item_id"), F.col(text_column).alias("text")).toLocalIterator():
        n = len(set(terms_of(row["text"])))
        if now and size + n > together:
            yield Items.of(now)
            now, size = [], 0
        now.append((row["item_id"], row["text"]))
        size += n
    if now:
        yield Items.of(now)


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values, kind))


def ends_of(column: pa.Array) -> np.ndarray:
    return column.offsets.to_numpy()[1:] - column.offsets.to_numpy()[0]


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms and tf (those of the vocabulary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = vocabulary.get, max(1, len(vocabulary))
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                n, keys = [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    found = terms_of(text)
                    n.append(len(found))
                    keys.append(np.array([x for x in map(number, found) if x is not None], np.int64) + row * size)
                key, tf = np.unique(np.concatenate(keys), return_counts=True)
                ends = np.searchsorted(key, np.arange(1, len(n) + 1) * size)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), lists((key % size).astype(np.int32), ends, pa.int32()), lists(tf.astype(np.int32), ends, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tf array<int>")


def frequencies(found: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each term: a row a task and term is shuffled,
    and a row a term of the items comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, length = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
            n = batch.column("n").to_numpy()
            n_docs, length = n_docs + int((n > 0).sum()), length + int(n.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]]).astype(np.int32)), pa.array(np.concatenate([df[at], [n_docs, length]]))], ["term", "n"])

    df, other = np.zeros(size, np.int64), {-1: 0, -2: 0}
    for row in found.select("n", "terms").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if row["term"] < 0:
            other[row["term"]] = row["n"]
        else:
            df[row["term"]] = row["n"]
    return other[-1], other[-2], df


@dataclass
class Plan:
    """What tasks need of the items: terms from the rarest to the most frequent are
    0, 1, 2 ...; `rank` maps the vocabulary's numbers to these.

    weights: per item its terms and their weights times repeats; beside: per term
    those from it on that an item holds too (its summary's coordinates); asking:
    the items that hold it."""

    n_docs: int
    length: int
    rank: np.ndarray
    idf: np.ndarray
    ids: list
    weights: list[tuple[np.ndarray, np.ndarray]]
    beside: list[np.ndarray]
    asking: list[np.ndarray]
    wide: int

    @classmethod
    def of(cls, items: Items, n_docs: int, length: int, df: np.ndarray, wide: int = WIDE) -> Plan:
        order = np.argsort(df, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        idf = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df[order]], np.int64)
        weights, beside, asking = [], [set() for _ in order], [[] for _ in order]
        for k, row in enumerate(items.rows):
            at = np.sort(rank[list(row)])
            weights.append((at, np.array([row[int(order[t])] for t in at], np.int64) * idf[at]))
            for j, t in enumerate(at):
                beside[t].update(at[j:].tolist() if len(at) <= wide else [int(t)])
                asking[t].append(k)
        return cls(n_docs, length, rank, idf, items.ids, weights, [np.array(sorted(x), np.int64) for x in beside], [np.array(x, np.int64) for x in asking], wide)


@cache
def directions(size: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((size, SKETCH)).astype(np.float32)


def clustered(members: np.ndarray, sketch: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """A posting list's members by cluster, and the ends of its blocks: each document is
    with the most similar of evenly spaced leaders, one for each `block` documents."""
    n = len(members)
    if n <= block:
        return members, np.array([n])
    leaders = members[np.arange(0, n, block)]
    nearest = np.argmax(sketch[members] @ sketch[leaders].T, axis=1)
    order = np.argsort(nearest, kind="stable")
    sizes = np.bincount(nearest, minlength=len(leaders))
    ends = np.cumsum(sizes)
    # a large cluster is cut on
    cuts = np.concatenate([np.append(np.arange(e - s + block, e, block), e) for s, e in zip(sizes, ends) if s])
    return members[order], cuts


def shard_rows(plan: Plan, doc_ids: np.ndarray, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, tf: np.ndarray, block: int) -> dict[str, tuple[np.ndarray, pa.DataType]]:
    """One shard's index: vectors (docs, ends, terms, vals), lists (list_terms, list_blocks:
    blocks up to its end), blocks (members up to block_ends) and their summaries."""
    m = 25 + (75 * n * plan.n_docs) // max(1, plan.length)
    row = np.repeat(np.arange(len(n)), np.diff(np.append(0, ends)))
    terms, vals = plan.rank[terms], (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
    # projections of the weighted vectors to unit length
    direction = directions(len(plan.rank))
    weighted = (plan.idf[terms] * vals).astype(np.float32)
    sketch = np.zeros((len(n), SKETCH), np.float32)
    filled = np.flatnonzero(np.diff(np.append(0, ends)))
    if len(filled):
        starts = np.append(0, ends[:-1])[filled]
        for k in range(SKETCH):
            sketch[filled, k] = np.add.reduceat(weighted * direction[terms, k], starts)
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    by_term = np.argsort(terms, kind="stable")
    at, first = np.unique(terms[by_term], return_index=True)
    last = np.append(first[1:], len(by_term))
    place = np.full(len(plan.rank), -1)
    members, block_ends, list_blocks, sum_terms, sum_vals, sum_ends, total, n_blocks, n_sums = [], [], [], [], [], [], 0, 0, 0
    for t, a, b in zip(at, first, last):
        docs, cuts = clustered(row[by_term[a:b]], sketch, block)
        coords = plan.beside[t]
        place[coords] = np.arange(len(coords))
        # all entries of the list's documents that its summaries keep
        starts = np.append(0, ends)[docs]
        sizes = ends[docs] - starts
        entry = np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        column = place[terms[entry]]
        keep = column >= 0
        of_block = np.repeat(np.searchsorted(cuts, np.arange(len(docs)), side="right"), sizes)
        dense = np.zeros(len(cuts) * len(coords), np.int64)
        key = (of_block * len(coords) + column)[keep]
        np.maximum.at(dense, key, vals[entry][keep])
        place[coords] = -1
        hit = np.flatnonzero(dense)
        sum_terms.append(coords[hit % len(coords)])
        sum_vals.append(dense[hit])
        sum_ends.append(n_sums + np.searchsorted(hit, np.arange(1, len(cuts) + 1) * len(coords)))
        members.append(docs)
        block_ends.append(total + cuts)
        total, n_blocks, n_sums = total + len(docs), n_blocks + len(cuts), n_sums + len(hit)
        list_blocks.append(n_blocks)
    joined = lambda x: np.concatenate(x) if x else np.array([], np.int64)
    small = pa.int32()
    return {
        "docs": (doc_ids, pa.int64()), "ends": (ends, small), "terms": (terms, small), "vals": (vals, small),
        "list_terms": (at, small), "list_blocks": (np.array(list_blocks, np.int64), small), "block_ends": (joined(block_ends), small), "members": (joined(members), small),
        "sum_ends": (joined(sum_ends), small), "sum_terms": (joined(sum_terms), small), "sum_vals": (joined(sum_vals), small),
    }


INDEX = ("docs", "ends", "terms", "vals", "list_terms", "list_blocks", "block_ends", "members", "sum_ends", "sum_terms", "sum_vals")


def index(found: DataFrame, plan: Plan, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """A row for each shard; see shard_rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            terms, tf = (t.column(c).combine_chunks() for c in ("terms", "tf"))
            ids = t.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy()
            got = shard_rows(plan, ids, t.column("n").to_numpy(), ends_of(terms).astype(np.int64), terms.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64), block)
            return pa.RecordBatch.from_arrays([lists(v, np.array([len(v)]), kind) for v, kind in got.values()], list(got))

        parts, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                parts.append(batch.slice(k, 512))
                size += parts[-1].num_rows
                if size >= shard:
                    yield flush(parts)
                    parts, size = [], 0
        if size:
            yield flush(parts)

    kinds = ", ".join(f"{c} array<{'bigint' if c == 'docs' else 'int'}>" for c in INDEX)
    return found.select("doc_id", "n", "terms", "tf").mapInArrow(run, kinds)


class Best:
    """The k best (score, id) of one item: higher scores, then smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.array([], np.int64), np.array([], np.int64)

    def least(self) -> int:
        """A document below this score is not among the best."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search_shard(plan: Plan, x: dict[str, np.ndarray], best: list[Best], counts: dict[str, int]) -> None:
    """One shard's documents into the best of each item; counts: blocks seen and scored."""
    starts = np.append(0, x["ends"])
    terms, vals = x["terms"].astype(np.int64), x["vals"].astype(np.int64)
    seen: dict[int, np.ndarray] = {}
    dense = np.zeros(len(plan.rank), np.int64)
    block_starts = np.append(0, x["block_ends"])
    sum_starts = np.append(0, x["sum_ends"])
    first = np.append(0, x["list_blocks"])
    for j, t in enumerate(x["list_terms"]):
        lo, hi = int(first[j]), int(first[j + 1])
        coords = plan.beside[t]
        a, b = int(sum_starts[lo]), int(sum_starts[hi])
        summary = np.zeros((hi - lo, len(coords)))
        of_block = np.repeat(np.arange(hi - lo), np.diff(sum_starts[lo : hi + 1]))
        summary[of_block, np.searchsorted(coords, x["sum_terms"][a:b])] = x["sum_vals"][a:b]
        for item in plan.asking[t]:
            at, w = plan.weights[item]
            here = np.searchsorted(at, t)
            bound = summary[:, np.searchsorted(coords, at[here:])] @ w[here:].astype(float) if len(at) <= plan.wide else np.full(hi - lo, np.inf)
            bound += bound * 2.0**-40
            counts["blocks"] += hi - lo
            order = np.argsort(-bound, kind="stable")
            # the most promising block first, then all that may still hold a better document
            for chosen in (order[:1], order[1:]):
                chosen = chosen[bound[chosen] >= best[item].least()]
                if not len(chosen):
                    break
                counts["scored"] += len(chosen)
                docs = np.concatenate([x["members"][block_starts[lo + c] : block_starts[lo + c + 1]] for c in chosen])
                if item not in seen:
                    seen[item] = np.zeros(len(x["docs"]), bool)
                docs = docs[~seen[item][docs]]
                seen[item][docs] = True
                if not len(docs):
                    continue
                dense[at] = w
                sizes = starts[docs + 1] - starts[docs]
                upto = np.cumsum(sizes)
                entry = np.repeat(starts[docs] - np.append(0, upto[:-1]), sizes) + np.arange(upto[-1])
                scores = np.add.reduceat(dense[terms[entry]] * vals[entry], np.append(0, upto[:-1]))
                dense[at] = 0
                good = scores >= best[item].least()
                best[item].add(scores[good], x["docs"][docs[good]])


def search(stored: DataFrame, plan: Plan, k: int = 10, counted: bool = False) -> DataFrame:
    """item (its place among the plan's), doc_id, score: the k best of each task. counted:
    instead one row a task of blocks seen and blocks scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, counts = [Best(k) for _ in plan.ids], {"blocks": 0, "scored": 0}
        for batch in batches:
            for row in range(batch.num_rows):
                search_shard(plan, {c: batch.column(c)[row].values.to_numpy() for c in INDEX}, best, counts)
        if counted:
            yield pa.RecordBatch.from_pydict({c: pa.array([n], pa.int64()) for c, n in counts.items()})
            return
        item = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        ids, scores = (np.concatenate([getattr(b, c) for b in best] or [np.array([], np.int64)]) for c in ("ids", "scores"))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return stored.mapInArrow(run, "blocks bigint, scored bigint" if counted else "item int, doc_id bigint, score bigint")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", shard: int = SHARD, block: int = BLOCK, wide: int = WIDE, together: int = 1 << 17) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 of each item."""
    spark = docs.sparkSession
    kind = items.schema[item_column].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for group in groups(items, item_column, item_text, together):
        if not group.ids:
            continue
        found = written(vectors(docs, group.vocabulary, id_column, text_column), "term-vectors")
        plan = Plan.of(group, *frequencies(found, len(group.vocabulary)), wide)
        stored = written(index(found, plan, shard, block), "blocked-index")
        erased(found)
        best = search(stored, plan, k)
        place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        names = spark.createDataFrame(list(enumerate(group.ids)), f"item int, item_id {kind}")
        top = best.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "item")
        out = out.unionByName(top.select("item_id", "rank", "doc_id", "score"))
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLE_SQL = {
    "op11_ranked_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
q AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
qt AS (SELECT item_id, unnest(w) AS t FROM q),
qc AS (SELECT item_id, t, count(*) AS q FROM qt GROUP BY ALL),
tot AS (SELECT count(*) FILTER (len(w) > 0) AS nd, sum(len(w))::BIGINT AS len FROM d),
dt AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM dt WHERE t IN (SELECT t FROM qc) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
v AS (SELECT r, doc_id, tf.t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // len))) AS v FROM tf JOIN df USING (t), tot),
s AS (SELECT item_id, r, doc_id, sum(q * v)::BIGINT AS score FROM v JOIN qc USING (t) GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= 10
"""
}
