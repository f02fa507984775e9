"""Byte-level BPE encoding and decoding by monoid tree reduction (operator 7).

Every text is halved down to leaves, and the encodings of neighbouring leaves are
joined pairwise up a tree. A join re-encodes a window around the border that grows
until the tokens outside it are proven stable, and keeps these:

* between pretokens: the left half's pretokens that end `margin` characters or more before the
  border were found without looking beyond it, so they stand. From there on pretokens
  are sought again, one by one, until one ends where one of the right half's ends; from there
  on both go on alike. Where the border cuts one pretoken in two, its tokens come from
  those of its two parts, as follows;
* inside one pretoken: it is halved down to `small` bytes, which are merged by rank,
  lowest first. A token sequence is an encoding exactly if every two neighbours
  are, so the window of tokens around a border doubles until its re-encoding
  begins and ends with the same tokens as before; then all pairs beyond it are as
  they were.

Encodings of pretokens are kept in a bounded table for the next time. Decoding
concatenates the bytes of the tokens up the same kind of tree.

Null and empty texts give no tokens and empty bytes. Rows are kept one for one,
repeated rows and ids included; other columns are ignored, whatever their names.
Texts may be of any length; work is a map over rows without a shuffle, with
memory in proportion to the longest text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.shared import table

class TreeCodec:
    """Encodes by joins in a tree, over leaves of `leaf` characters and pretokens' leaves
    of `small` bytes. joins and grown count the joins, and those whose window had to grow.
    The pattern must match every character, and decide on a match by `margin` - 1 characters
    after its end at most."""

    TABLE = 1 << 19

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = 1024, small: int = 32, margin: int = 8) -> None:
        import regex

        self.ranks, self.leaf, self.small, self.margin = ranks, leaf, small, margin
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.tokens[i] = b
        self.size = [len(b) for b in self.tokens]
        compiled = regex.compile(pattern)
        self.pretokens, self.matches = compiled.findall, compiled.finditer
        self.known: dict[str, list[int]] = {}
        self.joins = self.grown = 0

    def encode(self, text: str) -> list[int]:
        cuts = [*range(0, len(text), self.leaf), len(text)]
        level = [self.cut(text, a, b) for a, b in zip(cuts, cuts[1:])]
        while len(level) > 1:
            joined = [self.join(text, level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
            level = joined + level[len(joined) * 2 :]
        return level[0][2] if level else []

    def join(self, text: str, left: tuple, right: tuple) -> tuple:
        """The encoding of two neighbouring stretches: start, end, tokens, and the ends of
        their pretokens with the numbers of their tokens."""
        self.joins += 1
        lo, mid, ids, ends, sizes = left
        _, hi, more, more_ends, more_sizes = right
        keep, n = len(ends), len(ids)
        while keep and ends[keep - 1] > mid - self.margin:
            keep -= 1
            n -= sizes[keep]
        start = ends[keep - 1] if keep else lo
        new, new_ends, new_sizes, skip, m = [], [], [], 0, 0
        for match in self.matches(text, start, hi):
            end = match.end()
            while skip < len(more_ends) and more_ends[skip] < end:
                m += more_sizes[skip]
                skip += 1
            there = skip < len(more_ends) and more_ends[skip] == end
            if there and skip == 0 and len(ends) and match.start() == (ends[-2] if len(ends) > 1 else lo) and match.start() < mid:
                # the last pretoken on the left and the first one on the right are one
                self.grown += 1
                tokens = self.joined(ids[len(ids) - sizes[-1] :], more[: more_sizes[0]])
            else:
                tokens = self.pretoken(match[0])
            new += tokens
            new_ends.append(end)
            new_sizes.append(len(tokens))
            if there:
                m += more_sizes[skip]
                skip += 1
            if end == mid or there:
                break
        return lo, hi, ids[:n] + new + more[m:], ends[:keep] + new_ends + more_ends[skip:], sizes[:keep] + new_sizes + more_sizes[skip:]

    def cut(self, text: str, a: int, b: int) -> tuple:
        """A stretch of text by its pretokens, one after another."""
        found = self.pretokens(text, a, b)
        ids: list[int] = []
        sizes = []
        known = self.known
        for x in found:
            one = known.get(x)
            if one is None:
                one = self.pretoken(x)
            ids += one
            sizes.append(len(one))
        ends = list(accumulate(map(len, found), initial=a))[1:]
        return a, b, ids, ends, sizes

    def pretoken(self, x: str) -> list[int]:
        """A pretoken's tokens, out of the table if it is short and was seen before."""
        ids = self.known.get(x)
        if ids is None:
            ids = self.piece(x.encode("utf-8", "surrogatepass"))
            if len(x) <= 64:
                if len(self.known) >= self.TABLE:
                    self.known.clear()
                self.known[x] = ids
        return ids

    def piece(self, b: bytes) -> list[int]:
        """One pretoken, in halves."""
        if len(b) <= self.small:
            return self.merged(b)
        return self.joined(self.piece(b[: len(b) // 2]), self.piece(b[len(b) // 2 :]))

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two parts of a pretoken put together."""
        self.joins += 1
        w = 1
        while True:
            a, z = left[-w:], right[:w]
            mid = self.merged(self.decode(a) + self.decode(z))
            # the outermost tokens must stay, or be the ends of the pretoken's halves
            if (len(a) == len(left) or mid[0] == a[0]) and (len(z) == len(right) or mid[-1] == z[-1]) and (w > 1 or len(a) == len(left) and len(z) == len(right)):
                return left[: len(left) - len(a)] + mid + right[len(z) :]
            w *= 2
            self.grown += 1

    def merged(self, b: bytes) -> list[int]:
        """Neighbours merged as long as their bytes together have a rank, lowest rank first, leftmost of equal ones."""
        n = len(b)
        if n == 0:
            return []
        ranks = self.ranks
        if (whole := ranks.get(b)) is not None:
            return [whole]
        if n <= 64:
            return self.merged_short(b)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if ends[i] < 0 or ends[i] >= n or ends[ends[i]] != end:
                continue  # one of the two has been merged since
            gone = ends[i]
            ends[i], ends[gone] = end, -1
            if end < n:
                before[end] = i
                if (r := ranks.get(b[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (p := before[i]) >= 0 and (r := ranks.get(b[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[b[i : ends[i]]])
            i = ends[i]
        return out

    def merged_short(self, b: bytes) -> list[int]:
        """merged() by looking for the least rank again after each merge."""
        get, none = self.ranks.get, len(self.tokens)
        at = list(range(len(b) + 1))
        ranks = [get(b[i : i + 2], none) for i in range(len(b) - 1)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            del at[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(b[at[i] : at[i + 2]], none)
            if i:
                ranks[i - 1] = get(b[at[i - 1] : at[i + 1]], none)
        return [self.ranks[b[x:y]] for x, y in zip(at, at[1:])]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join([self.tokens[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_codecs: dict[tuple, TreeCodec] = {}


def codec(path: str, pattern: str, leaf: int = 1024) -> TreeCodec:
    """The process's codec for a rank file."""
    if (path, pattern, leaf) not in _codecs:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _codecs[path, pattern, leaf] = TreeCodec(ranks, pattern, leaf)
    return _codecs[path, pattern, leaf]


def encode_decode(docs: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", leaf: int = 1024, rows: int = 512) -> DataFrame:
    """One row per document: id, ids array<int>, decoded binary (of these ids).

    rows: documents in one batch that goes back to Spark.
    """
    kind = docs.schema[id_column].dataType
    schema = pa.schema([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern, leaf)
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                ids = [c.encode(t or "") for t in part.column("text").to_pylist()]
                flat = np.fromiter((x for one in ids for x in one), np.int32, sum(map(len, ids)))
                offsets = np.append(0, np.cumsum([len(one) for one in ids])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                decoded = pa.array([c.decode(one) for one in ids], schema.field("decoded").type)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, decoded], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, ids array<int>, decoded binary")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def digests(docs: DataFrame, ranks: str, pattern: str, leaf: int = 1024) -> DataFrame:
    """Per document the number of tokens and SHA-256 of ids and of decoded bytes."""
    return encode_decode(docs, ranks, pattern, leaf=leaf).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
