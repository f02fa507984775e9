"""SimHash near-duplicate classes by a binary trie self-join (operator 1).

1. Fingerprints: each document's 64-bit SimHash over its word shingles, in an
   Arrow map beside the scan; (id, fingerprint) is written once.
2. Equal fingerprints are pre-aggregated to one row.
3. Trie self-join. Two fingerprints within `errors` bits agree wholly on m - errors
   of any m blocks of bits. Each choice of so many blocks in turn is put first; the
   trie over the turned fingerprints then only has to be joined below equal
   prefixes, which are independent of each other and so are Spark's partitioning
   key. m grows with the logarithm of the number of fingerprints, so that about
   `most` of them or fewer share a prefix: 4 errors take 5 prefixes of 12 bits,
   15 of 20, 35 of 26. Within a key, node pairs are walked together from the top:
   each step adds the bit in which the children differ, and a pair of nodes is
   dropped when the errors exceed the budget. A key that still has more than
   4 * most fingerprints is dealt into parts by hash, and each pair of parts is a
   task's key, so no task holds more than that, and no pair is lost.
4. Each task reduces the links that it finds to a spanning forest, so rows do not
   grow with the square of a group. Components of all forests come from
   minimum labels by star rounds over tables in the shared folder.

similar_classes() does the same for texts of a shingle similarity of 0.8 or more,
where one fingerprint within a few bits is not enough; see there.

Documents without words (null, empty, white space) have fingerprint zero and are
linked like any other. Texts may be of any length; a task holds one at a time.
Rows with a null id are kept; they take part with the id null, and a component
made of null ids only has component_id null. Repeated ids stay separate rows;
columns beyond id and text are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.passages import mixed, shingles
from seamline.llm.shared import erased, salted_join, table, written

BITS = 64
SEED = 42
#: Sets of fewer shingles get a wider limit of differing bits.
SMALL = 64
#: Nodes that are broadcast at most, to pick their texts where these lie.
BROADCAST = 2_000_000


def fingerprint(text: str | None, size: int = 4) -> int:
    """SimHash of lower-cased (A-Z) word shingles; zero without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[size - 1 :].tolist() if len(words) > size else [len(line)]
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(first, last)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 4) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""
    kind = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            fp = np.array([fingerprint(t.as_py(), size) for t in text], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def trie_pairs(key: np.ndarray, part: np.ndarray, fp: np.ndarray, errors: int, small: int = 48) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (in chunks) of fingerprints within `errors` bits and of equal
    key. part: 0 or 1 where a key joins two parts with each other (only pairs
    across count), 2 where a key's members are joined among themselves.

    Rows must be sorted by (key, part, fp), and so each trie node is a range of
    rows; all keys are walked at once, level by level.
    """
    n = len(fp)
    if not n:
        return
    edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
    lo, hi = edge, np.append(edge[1:], n)
    alone = part[lo] == 2
    two = np.flatnonzero((part[lo] == 0) & np.append((part[lo][1:] == 1) & (key[lo][1:] == key[lo][:-1]), False)[: len(lo)])
    a_lo, a_hi = np.concatenate([lo[alone], lo[two]]), np.concatenate([hi[alone], hi[two]])
    b_lo, b_hi = np.concatenate([lo[alone], lo[two + 1]]), np.concatenate([hi[alone], hi[two + 1]])
    wrong = np.zeros(len(a_lo), np.int64)
    for level in range(BITS - 1, -2, -1):
        leaf = ((a_hi - a_lo) * (b_hi - b_lo) <= small) | (level < 0)
        yield from compare(fp, a_lo[leaf], a_hi[leaf], b_lo[leaf], b_hi[leaf], errors)
        keep = ~leaf
        a_lo, a_hi, b_lo, b_hi, wrong = a_lo[keep], a_hi[keep], b_lo[keep], b_hi[keep], wrong[keep]
        if not len(a_lo):
            return
        ones = np.append(0, np.cumsum((fp >> np.uint64(level)) & np.uint64(1), dtype=np.int64))
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        same = a_lo == b_lo
        children = [(a_lo, a_mid, b_lo, b_mid, wrong), (a_mid, a_hi, b_mid, b_hi, wrong), (a_lo, a_mid, b_mid, b_hi, wrong + 1)]
        children.append(tuple(x[~same] for x in (a_mid, a_hi, b_lo, b_mid, wrong + 1)))
        a_lo, a_hi, b_lo, b_hi, wrong = (np.concatenate(x) for x in zip(*children))
        keep = (wrong <= errors) & (a_lo < a_hi) & (b_lo < b_hi)
        keep &= (a_lo != b_lo) | (a_hi - a_lo > 1)
        a_lo, a_hi, b_lo, b_hi, wrong = a_lo[keep], a_hi[keep], b_lo[keep], b_hi[keep], wrong[keep]


def compare(fp: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray, errors: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of small node pairs, by population count."""
    size = (a_hi - a_lo) * (b_hi - b_lo)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        s = size[at:to]
        node = np.repeat(np.arange(at, to), s)
        k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
        width = (b_hi - b_lo)[node]
        i, j = a_lo[node] + k // width, b_lo[node] + k % width
        near = (i < j) | (a_lo[node] != b_lo[node])
        i, j = i[near], j[near]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= errors
        yield i[near], j[near]
        at = to


class Forest:
    """Minimum labels of rows under links that come in chunks."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            live = a != b
            i, j, a, b = i[live], j[live], a[live], b[live]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def prefixes(errors: int, count: int, most: int) -> list[list[tuple[int, int]]]:
    """Which blocks [from, to) of bits, counted from the top, stand first in each turn: all
    choices of m - errors out of m blocks, for the least m with about `most` or
    fewer of `count` fingerprints to a prefix."""
    for m in range(errors + 1, BITS + 1):
        blocks = [(BITS * k // m, BITS * (k + 1) // m) for k in range(m)]
        if (m - errors) * (BITS // m) >= math.log2(max(count, 1) / most) or math.comb(m + 1, errors) > 500:
            break
    return [list(c) for c in combinations(blocks, m - errors)]


def turned(fp: np.ndarray, first: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints with the given blocks put first, then all other bits in their order."""
    put = sorted(first)
    rest = [(a, b) for a, b in zip([0, *(b for _, b in put)], [*(a for a, _ in put), BITS]) if a < b]
    out, at = np.zeros(len(fp), np.uint64), BITS
    for a, b in [*put, *rest]:
        at -= b - a
        out |= ((fp >> np.uint64(BITS - b)) & np.uint64((1 << (b - a)) - 1)) << np.uint64(at)
    return out


def links(fps: DataFrame, errors: int = 4, most: int = 1024) -> DataFrame:
    """Spanning links (a, b) with a < b (as signed longs) of the fingerprints in
    column fp (distinct), such that links join exactly the pairs within `errors`
    bits, directly or through others."""
    turns = prefixes(errors, fps.count(), most)
    top = [F.xxhash64(*(F.shiftrightunsigned(F.shiftleft("fp", a), BITS - b + a) for a, b in blocks)) for blocks in turns]
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), x.alias("block")) for k, x in enumerate(top)))).alias("k")).select("fp", "k.*")
    # prefixes of one fingerprint need no join; crowded ones are few, as m grows with the count
    crowd = written(keyed.groupBy("turn", "block").count().where("count > %d" % (4 * most)).select("turn", "block", F.ceil(F.col("count") / (2 * most)).cast("int").alias("parts")), "crowded")
    dealt = keyed.join(crowd, ["turn", "block"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # a part meets itself (side 2) and each other part once (sides 0 and 1)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select(F.xxhash64("turn", "block", low, high).alias("key"), "turn", side.cast("byte").alias("part"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(rows: list[np.ndarray]) -> pa.RecordBatch:
            key, turn, part, fp = rows
            spun = fp.copy()
            for k in np.unique(turn).tolist():
                spun[turn == k] = turned(fp[turn == k], turns[k])
            order = np.lexsort((spun, part, key))
            key, part, fp, spun = key[order], part[order], fp[order], spun[order]
            # equal fingerprints of different keys are different rows here; the forest joins within keys
            forest = Forest(len(fp))
            for i, j in trie_pairs(key, part, spun, errors):
                forest.add(i, j)
            child = np.flatnonzero(forest.root != np.arange(len(fp)))
            a, b = fp[forest.root[child]].view(np.int64), fp[child].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            key, turn, part, fp = (np.asarray(batch.column(k)) for k in range(4))
            rows = [key, turn, part, fp.astype(np.int64).view(np.uint64)]
            if held:
                rows = [np.concatenate([h, r]) for h, r in zip(held.pop(), rows)]
            # the last key may go on in the next batch
            cut = int(np.searchsorted(rows[0], rows[0][-1], side="left")) if len(rows[0]) else 0
            if cut > 60_000:
                yield joined([r[:cut] for r in rows])
                rows = [r[cut:] for r in rows]
            held.append(rows)
        if held and len(held[0][0]):
            yield joined(held.pop())

    found = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    return found.where("a != b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the component's least node) for all nodes of edges (a, b),
    by large-star and small-star rounds; each round is a table in the shared
    folder. Hot nodes are only ever joined to one row per node and aggregated by
    minimum, so Spark can split them."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name)
    while True:
        # large star: larger neighbours of a node get its least neighbour (itself included)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: smaller neighbours and the node itself get the least one
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b")))).alias("e")).select("e.*")
        following = written(small.where("a < b").distinct(), name)
        # done when every node has one parent and no parent is a child
        child = following.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("root"))
        unsettled = child.where("n > 1").select("b").union(following.join(following.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("b"))
        edges = following
        if unsettled.isEmpty():
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 4, errors: int = 4, most: int = 1024) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id
    (the least id that links reach, its own included)."""
    prints = written(fingerprints(docs, id_column, text_column, size), "fingerprints")
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    grouped = components(links(fps, errors, most))
    member = fps.join(grouped.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    member = written(member, "members")
    first = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(salted_join(member, first, ["root"]).select("fp", "component_id"), "classes")
    return salted_join(prints, of, ["fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """32-bit hashes of (shingle, how often it stood before): the multiset as a set, sorted."""
    h = shingles(text) if size == 5 else np.zeros(0, np.uint64)
    if not len(h):
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        n = max(len(words) - size + 1, 1) if words else 0
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + size])) for i in range(n)], np.uint64)
    h = np.sort(h)
    first = np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1]), np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
    again = np.arange(len(h)) - first
    return np.unique((mixed(h + again.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32))


def wide_fingerprint(members: np.ndarray, prints: int) -> np.ndarray:
    """`prints` independent 64-bit SimHashes of a shingle set."""
    turn = np.arange(1, prints + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(prints * BITS, np.float64)
    for k in range(0, len(members), 4096):
        bits = np.unpackbits(mixed(members[k : k + 4096].astype(np.uint64)[:, None] + turn).view(np.uint8), axis=1, bitorder="little")
        ones += np.ones(len(bits), np.float32) @ bits.astype(np.float32)
    return np.packbits(2 * ones > len(members), bitorder="little").view(np.int64)


def nearest_partners(lists: list[list[np.ndarray]], partners: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of lists (place, other, distance) the `partners` nearest of each place, and the places that had more."""
    place, other, d = (np.concatenate(x) for x in zip(*lists))
    order = np.lexsort((other, d, place))
    place, other, d = place[order], other[order], d[order]
    rank = np.arange(len(place)) - np.searchsorted(place, place, side="left")
    keep = rank < partners
    return [place[keep], other[keep], d[keep]], np.unique(place[~keep])


def most_differing(similarity: float, bits: int, small: bool) -> int:
    """Differing bits that two shingle sets of this similarity pass with chance below 3e-4.

    Sets of a Jaccard similarity s have a cosine of 2s / (1 + s) or more, so a bit differs
    with chance arccos(that) / pi at most. In small sets ties of the majority add to it: at
    0.8 four shingles of five differ in 3 of 16 bits, the most of any sizes; other
    similarities keep the same ratio."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi * (1.25 if small else 1.0)
    return int(bits * p + 3.5 * np.sqrt(bits * p * (1 - p)))


def similar_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, similarity: float = 0.8, prints: int = 16, errors: int = 20, seen: int = 8, again: int = 4) -> DataFrame:
    """doc_id, component_id (least id of the class): classes under links between texts whose
    shingles (words lower-cased A-Z) have a multiset Jaccard similarity of `similarity` or more.

    At 0.8 two SimHashes differ in 15 % of their bits, about 10 of 64, more than a
    trie over one fingerprint can be joined for. So each document has `prints`
    independent fingerprints of four blocks of 16 bits. Tries are joined below each
    equal block with a budget of `errors` for the fingerprint. A pair must also have
    sizes that allow the similarity, and may differ over `seen` fingerprints together in
    no more bits than all but 3e-4 of the pairs at `similarity` do. With 16
    fingerprints a pair at 0.8 shares none of 64 blocks with chance 0.008 (by
    calculation, (1 - 0.85 ** 16) ** 64), one at 0.85 with 0.001, one at 0.9 with 1e-5. In
    each block each fingerprint first keeps its nearest one on either side of it in the
    trie's order, so rows do not grow with the square of a group of copies. All links
    are verified by the exact similarity of the shingle multisets before they count.
    The four blocks of the first fingerprint go first; then all blocks, where
    only fingerprints of other classes than the own one so far count as near ones, and `again`
    fingerprints are held against each other, as a row for each block carries them.
    Blocks where a fingerprint had more of those go once more with all of them, held
    against each other over all `prints` fingerprints: every pair of the tries is either
    within one class or compared exactly.

    Equal multisets are one node from the start; documents without words are one class.
    """
    kind = docs.schema[id_column].dataType

    def node_of(members: np.ndarray) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(members.tobytes())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = [shingle_set(t.as_py(), size) for t in part.column("text")]
                node = np.array([node_of(x) for x in sets], np.uint64).view(np.int64)
                w = pa.array([wide_fingerprint(x, prints).tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(node), w, pa.array([len(x) for x in sets], pa.int32())], ["doc_id", "node", "w", "n"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                sets = [shingle_set(t.as_py(), size) for t in batch.column("text").slice(k, 512)]
                node = np.array([node_of(x) for x in sets], np.uint64).view(np.int64)
                members = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int32) if sets else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(node), members], ["node", "members"])

    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    sketched = written(texts.mapInArrow(sketch, f"doc_id {kind.simpleString()}, node long, w binary, n int"), "sketches")
    nodes = written(sketched.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("w").alias("w"), F.min("n").alias("n")), "nodes")

    def run(batches: Iterator[pa.RecordBatch], held_prints: int, partners: int | None) -> Iterator[pa.RecordBatch]:
        limits = np.array([most_differing(similarity, held_prints * BITS, small) for small in (False, True)])

        def table_of(pairs: np.ndarray, crowded: np.ndarray) -> pa.RecordBatch:
            none = lambda n: pa.nulls(n, pa.int64())
            pairs = np.unique(np.sort(pairs, axis=0), axis=1)
            columns = [pa.concat_arrays([pa.array(x), none(len(crowded))]) for x in pairs] + [pa.concat_arrays([none(pairs.shape[1]), pa.array(crowded)])]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "crowded"])

        def near(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, wide, n, node, own = rows
            fp = wide[:, 0].copy()
            for b in range(4):
                of = (key >> 16) % 4 == b
                fp[of] = turned(fp[of], [(16 * b, 16 * b + 16)])
            order = np.lexsort((fp, key))
            key, wide, n, node, own, fp = key[order], wide[order], n[order], node[order], own[order], fp[order]
            # before and behind each fingerprint are places of their own: 2 * row + side
            lists, waiting, count = [np.zeros(0, np.int64)] * 3, [], 0
            crowded = np.zeros(len(key), bool)
            for i, j in trie_pairs(key, np.full(len(key), 2, np.int8), fp, errors):
                ok = (own[i] != own[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
                i, j = np.minimum(i[ok], j[ok]), np.maximum(i[ok], j[ok])
                d = np.zeros(len(i), np.int64)
                for k in range(held_prints):
                    d += np.bitwise_count(wide[i, k] ^ wide[j, k])
                ok = d <= limits[(np.minimum(n[i], n[j]) < SMALL).astype(int)]
                i, j, d = i[ok], j[ok], d[ok]
                count += len(i)
                waiting.append([i, j, d] if partners is None else [np.concatenate([2 * j, 2 * i + 1]), np.concatenate([i, j]), np.concatenate([d, d])])
                if count > 1 << 20:
                    if partners is None:
                        yield table_of(np.concatenate([np.stack([node[p], node[q]]) for p, q, _ in waiting], axis=1), key[:0])
                    else:
                        lists, full = nearest_partners([lists, *waiting], partners)
                        crowded[full >> 1] = True
                    waiting, count = [], 0
            if partners is None:
                yield table_of(np.concatenate([np.zeros((2, 0), np.int64), *(np.stack([node[p], node[q]]) for p, q, _ in waiting)], axis=1), key[:0])
                return
            lists, full = nearest_partners([lists, *waiting], partners)
            crowded[full >> 1] = True
            yield table_of(np.stack([node[lists[0] >> 1], node[lists[1]]]), np.unique(key[crowded]))

        held: list[np.ndarray] = []
        for batch in batches:
            wide = np.frombuffer(b"".join(batch.column("wide").to_pylist()), "<u8").reshape(-1, held_prints)
            key, n, node, own = (np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "n", "node", "own"))
            rows = [key, wide, n, node, own]
            held = [np.concatenate([h, r]) for h, r in zip(held, rows)] if held else rows
            cut = int(np.searchsorted(held[0], held[0][-1], side="left")) if len(held[0]) else 0
            if cut > 60_000:
                yield from near([r[:cut] for r in held])
                held = [r[cut:] for r in held]
        if held and len(held[0]):
            yield from near(held)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                p, q = x[k].values.to_numpy(), y[k].values.to_numpy()
                s = len(np.intersect1d(p, q, assume_unique=True))
                keep[k] = s >= similarity * (len(p) + len(q) - s) - 1e-9
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    def similar(rows: DataFrame, turns: int, held_prints: int, partners: int | None, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Verified links of rows (node, w, n, own) by the first `turns` blocks, those of equal own
        left out; and the blocks where a fingerprint had more than `partners` near ones on a side."""
        # fingerprints are little-endian, so a block's two bytes stand in reverse
        block = F.conv(F.hex(F.expr("substring(w, 8 * shiftright(turn, 2) + 7 - 2 * (turn % 4), 2)")), 16, 10).cast("long")
        spread = rows.select("node", "own", "n", "w", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
        keyed = spread.select((F.col("turn") * F.lit(65536).cast("long") + block).alias("key"), F.expr(f"substring(concat(w, w), 8 * shiftright(turn, 2) + 1, {8 * held_prints})").alias("wide"), "n", "node", "own")
        # there are 65,536 blocks a turn, so the crowded ones may be broadcast, and no other row is shuffled
        keyed = keyed if only is None else keyed.join(F.broadcast(only), "key", "left_semi")
        near = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: run(batches, held_prints, partners), "a long, b long, crowded long")
        every = written(near.distinct(), "candidates")
        found = every.where("a is not null").select("a", "b")
        asked = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
        # sets are made anew from the texts that stand for the nodes, as they are larger than all else
        small = (lambda x: F.broadcast(x)) if asked.count() <= BROADCAST else (lambda x: x)
        ids = nodes.join(small(asked), "node", "left_semi").select(F.col("least").alias("id")).distinct()
        picked = texts.join(small(ids), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
        sets = picked.mapInArrow(shingled, "node long, members array<int>").join(small(asked), "node", "left_semi")
        sets = written(sets.dropDuplicates(["node"]), "shingle-sets")
        both = salted_join(salted_join(found, sets.select(F.col("node").alias("a"), F.col("members").alias("x")), ["a"]), sets.select(F.col("node").alias("b"), F.col("members").alias("y")), ["b"], found)
        links = written(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "similar")
        erased(sets)
        return links, every.where("crowded is not null").select(F.col("crowded").alias("key"))

    found, _ = similar(nodes.withColumn("own", F.col("node")), 4, seen, 1)
    crowded = None
    for held_prints, partners in ((again, 1), (prints, None)):
        grouped = components(found)
        if crowded is None or not crowded.isEmpty():
            root = grouped.select("node", F.col("root").alias("own"))
            known = written(nodes.join(root, "node", "left").select("node", "w", "n", F.coalesce("own", "node").alias("own")), "known")
            more, crowded = similar(known, 4 * prints, held_prints, partners, crowded)
            found = found.union(more)
            erased(known)
    grouped = components(found)
    member = written(nodes.select("node", "least").join(grouped, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "members")
    first = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(salted_join(member, first, ["root"]).select("node", "component_id"), "classes")
    out = written(salted_join(sketched.select("doc_id", "node"), of, ["node"]).select("doc_id", "component_id"), "similar-classes")
    for done in (sketched, nodes, member, of):
        erased(done)
    return out


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash}
ORACLE_SQL: dict[str, str] = {}
