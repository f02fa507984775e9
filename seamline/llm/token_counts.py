"""Token counts by compiled finite-state transducers (operator 2).

Two deterministic transducers replace the tokenizer:

* the *cutter* reads character classes and marks where pretokens begin. It has
  twelve states and is compiled completely. A text is cut into chunks; each
  chunk becomes a map from every state to the state after it, the maps are
  composed by a parallel prefix scan, and with the states that the scan gives
  all chunks are marked independently of each other;
* the *merger* reads the bytes of a pretoken. A state is the set of vocabulary
  prefixes that are still open, each with the token before it and the number
  of tokens there; a transition is annotated with the change of the token
  count of what was read so far. States are determinised as the data need them
  and kept in a bounded table that starts anew when it is full.

Why the merger gives the library's counts: in byte-pair encoding every prefix
of an encoding is the encoding of a prefix, so the text up to each byte has one
last token, and a token sequence is an encoding exactly if all adjacent pairs
are (no merge across the border happens while both sides are alive).

Null and empty texts count zero tokens. Rows are kept one for one, repeated
rows and ids included; other columns are ignored. A text of any length is
processed whole, in memory proportional to its length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.shared import table

# Character classes of the cutter.
SPACE, WHITE, STMD, R, V, L, E, LETTER, NUMBER, QUOTE, OTHER = range(11)
# Its states: text or token start, white runs (one or more characters, ending in
# a space or not), letters, numbers, others, and a quote with what follows it.
START, W1S, W1O, W2S, W2O, IN_L, IN_N, IN_P, Q, QR, QV, QL = range(12)
HERE, BEFORE = 1, 2


def compile_cutter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks for each state and class. HERE: a pretoken begins at
    this character; BEFORE: one begins at the character before it, which only
    this character decides (the last of several white characters goes to the
    next pretoken; a quote with r, v or l that is no contraction)."""
    nxt, out = np.zeros((12, 11), np.uint8), np.zeros((12, 11), np.uint8)
    fresh = {SPACE: W1S, WHITE: W1O, NUMBER: IN_N, QUOTE: Q, OTHER: IN_P}
    fresh |= {c: IN_L for c in (STMD, R, V, L, E, LETTER)}
    kind = {c: s for c, s in fresh.items() if c != QUOTE} | {QUOTE: IN_P}
    for s in range(12):
        for c in range(11):
            if s in (W1S, W1O, W2S, W2O):
                if c in (SPACE, WHITE):
                    nxt[s, c], out[s, c] = (W2S if c == SPACE else W2O), 0
                    continue
                mark = BEFORE if s in (W2S, W2O) else 0
                if s in (W1S, W2S):  # the space belongs to what follows
                    nxt[s, c], out[s, c] = kind[c], mark
                else:
                    nxt[s, c], out[s, c] = fresh[c], mark | HERE
                continue
            stays = {IN_L: fresh[c] == IN_L, IN_N: c == NUMBER, IN_P: c in (QUOTE, OTHER)}.get(s, False)
            if stays:
                nxt[s, c] = s
            elif s == Q and c == STMD or (s, c) in ((QR, E), (QV, E), (QL, L)):
                nxt[s, c] = START
            elif s == Q and c in (R, V, L):
                nxt[s, c] = {R: QR, V: QV, L: QL}[c]
            elif s == Q and c in (QUOTE, OTHER):
                nxt[s, c] = IN_P
            elif s in (QR, QV, QL):
                nxt[s, c], out[s, c] = fresh[c], BEFORE | (0 if fresh[c] == IN_L else HERE)
            else:
                nxt[s, c], out[s, c] = fresh[c], HERE
    return nxt, out


def character_classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    every = "".join(map(chr, (x for x in range(0x110000) if not 0xD800 <= x < 0xE000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, every):
            for lo, hi in ((ord(m[0][0]), ord(m[0][-1]) + 1),):
                out[lo:hi] = kind
    out[0xD800:0xE000] = OTHER
    for kind, chars in ((SPACE, " "), (STMD, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e"), (QUOTE, "'")):
        for c in chars:
            out[ord(c)] = kind
    return out


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (rows), in log2 rounds."""
    out, step = maps.copy(), 1
    while step < len(out):
        # after round k, row i holds the composition of the last 2**k maps up to i
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), axis=1)
        step *= 2
    return out


class Cutter:
    """Marks pretoken starts in many texts at once."""

    CHUNK, TAIL = 512, 32

    def __init__(self) -> None:
        nxt, self.out = compile_cutter()
        self.nxt, self.width = nxt.ravel(), nxt.shape[1]
        self.out, self.classes = self.out.ravel(), character_classes()

    def maps(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The state map of each chunk [lo, hi). A map that is already constant
        over the chunk's last characters is so over all of it; the others are
        run over tails that double until they cover the chunk."""
        out = np.tile(np.arange(12, dtype=np.uint8), (len(lo), 1))
        todo, tail = np.arange(len(lo)), self.TAIL
        while len(todo):
            a, b = np.maximum(lo[todo], hi[todo] - tail), hi[todo]
            m = np.tile(np.arange(12, dtype=np.intp), (len(todo), 1))
            for back in range(tail, 0, -1):
                on = np.flatnonzero(b - back >= a)
                if len(on):
                    m[on] = self.nxt[m[on] * self.width + c[b[on] - back][:, None]]
            out[todo] = m
            todo = todo[(m != m[:, :1]).any(axis=1) & (a > lo[todo])]
            tail *= 4
        return out

    def starts(self, c: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Marks where pretokens start; c: classes of all texts, one after another."""
        ends = np.cumsum(lengths)
        begins = ends - lengths
        n = -(-lengths // self.CHUNK)
        first = np.cumsum(n) - n
        text = np.repeat(np.arange(len(lengths)), n)
        lo = begins[text] + (np.arange(n.sum()) - first[text]) * self.CHUNK
        hi = np.minimum(lo + self.CHUNK, ends[text])
        flags = np.zeros(len(c), bool)
        if not len(lo):
            return flags
        maps = self.maps(c, lo, hi)
        opening = np.zeros(len(lo), bool)
        opening[first[n > 0]] = True
        maps[opening] = maps[opening][:, [START]]  # a text's first chunk starts at START whatever was before
        after = scan(maps)[:, START]
        s = np.where(opening, START, np.roll(after, 1)).astype(np.intp)
        order = np.argsort(lo - hi, kind="stable")
        lo, size, s = lo[order], (hi - lo)[order], s[order]
        for p in range(int(size[0])):
            k = int(np.searchsorted(-size, -p, side="left"))
            at = lo[:k] + p
            key = s[:k] * self.width + c[at]
            mark = self.out[key]
            flags[at[(mark & HERE) > 0]] = True
            flags[at[(mark & BEFORE) > 0] - 1] = True
            s[:k] = self.nxt[key]
        # a quote with r, v or l that ends the text is two pretokens
        closing = np.flatnonzero(n > 0)
        last = after[first[closing] + n[closing] - 1]
        flags[ends[closing[np.isin(last, (QR, QV, QL))]] - 1] = True
        flags[begins[lengths > 0]] = True
        return flags


class Merger:
    """The lazily determinised transducer of one merge list.

    What a state keeps of the token before an open prefix is its *edge*: those
    of the tokens at its right side, while it is built, that have a merge which
    the open prefix can still meet. Tokens with equal edges share states.
    """

    LIMIT = 1 << 17

    def __init__(self, tokens: list[bytes], merges: dict[tuple[int, int], int], made: dict[int, tuple[int, int, int]]) -> None:
        """merges: rank of each pair; made: token -> (left, right, rank)."""
        self.merges, self.made = merges, made
        self.child: list[dict[int, int]] = [{}]
        self.token, self.parent = [-1], [-1]
        node_of = {}
        for t, b in enumerate(tokens):
            node = 0
            for x in b:
                if (to := self.child[node].get(x)) is None:
                    to = self.child[node][x] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                    self.parent.append(node)
                node = to
            self.token[node], node_of[t] = t, node
        self.below = [0] * len(self.child)
        for n in range(len(self.child) - 1, 0, -1):  # children come after their parents
            self.below[self.parent[n]] += 1 + self.below[n]
        self.partners: dict[int, list[tuple[int, int]]] = {}
        for (x, y), rank in merges.items():
            self.partners.setdefault(x, []).append((node_of[y], rank))
        self.met: dict[tuple[int, float], tuple[set[int], set[int]]] = {}
        self.left: dict[int, list[tuple[int, float]]] = {}
        self.clear()

    def clear(self) -> None:
        self.edges: list[tuple] = [()]
        self.edge_number: dict[tuple, int] = {(): 0}
        self.trimmed: dict[tuple[int, int], int] = {}
        self.full: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.alive: dict[tuple[int, int], bool] = {}
        self.states: list[tuple] = [((0, 0, 0),)]
        self.number = {self.states[0]: 0}
        self.step = np.full(1024 * 256, -1, np.int32)

    def spine(self, t: int, side: int) -> list[tuple[int, float]]:
        """The tokens at the right (0) or left (1) side of t while it is built,
        each with the rank at which it is taken up into the next."""
        out, ends = [], float("inf")
        while True:
            out.append((t, ends))
            if t not in self.made:
                return out
            a, b, ends = self.made[t]
            t = (b, a)[side]

    def meets(self, x: int, ends: float, node: int) -> bool:
        """Whether a token that continues node can begin with a partner of x."""
        if (x, ends) not in self.met:
            at = {n for n, rank in self.partners.get(x, ()) if rank < ends}
            above = set()
            for n in at:
                while n >= 0 and n not in above:
                    above.add(n)
                    n = self.parent[n]
            self.met[x, ends] = at, above
        at, above = self.met[x, ends]
        if node in above:
            return True
        while node > 0:
            if node in at:
                return True
            node = self.parent[node]
        return False

    def trim(self, edge: int, node: int) -> int:
        """The edge without what no continuation of node can meet."""
        if not edge:
            return 0
        if (got := self.trimmed.get((edge, node))) is None:
            got = self.trimmed[edge, node] = self.edge(tuple(x for x in self.edges[edge] if self.meets(*x, node)))
        return got

    def edge(self, x: tuple) -> int:
        if (k := self.edge_number.get(x)) is None:
            k = self.edge_number[x] = len(self.edges)
            self.edges.append(x)
        return k

    def pair(self, edge: int, t: int) -> bool:
        """Whether t stays a token of its own after a token with this edge."""
        if not edge:
            return True
        if (ok := self.fits.get((edge, t))) is None:
            if t not in self.left:
                self.left[t] = self.spine(t, 1)
            ok = True
            for x, x_ends in self.edges[edge]:
                for y, y_ends in self.left[t]:
                    rank = self.merges.get((x, y))
                    if rank is not None and rank < x_ends and rank <= y_ends:
                        ok = False
            self.fits[edge, t] = ok
        return ok

    def open(self, edge: int, node: int) -> bool:
        """Whether some longer token through node stays apart from the edge."""
        if not edge or self.below[node] > 24:
            return self.below[node] > 0  # not worth the search
        if (got := self.alive.get((edge, node))) is None:
            got = any((t := self.token[c]) >= 0 and self.pair(edge, t) or self.open(self.trim(edge, c), c) for c in self.child[node].values())
            self.alive[edge, node] = got
        return got

    def add(self, state: int, byte: int) -> None:
        """Determinises one transition: next state times 64, plus the change of count plus 32."""
        opened, last, count = [], None, 0
        for node, before, rel in self.states[state]:
            to = self.child[node].get(byte)
            if to is None:
                continue
            t = self.token[to]
            if t >= 0 and self.pair(before, t):
                last, count = t, rel + 1
            if self.open(edge := self.trim(before, to), to):
                opened.append((to, edge, rel))
        if last is None:
            raise ValueError("the vocabulary lacks a byte")
        if (edge := self.full.get(last)) is None:
            edge = self.full[last] = self.edge(tuple(x for x in self.spine(last, 0) if self.meets(*x, 0)))
        new = (*((n, b, r - count) for n, b, r in opened), (0, edge, 0))
        if (k := self.number.get(new)) is None:
            k = self.number[new] = len(self.states)
            self.states.append(new)
            if (k + 1) * 256 > len(self.step):
                self.step = np.concatenate([self.step, np.full(len(self.step), -1, np.int32)])
        self.step[state * 256 + byte] = k * 64 + count + 32

    def changes(self, x: np.ndarray, starts: np.ndarray, lane: int = 4133) -> np.ndarray:
        """The change of the token count at each byte; starts: where pretokens start."""
        out = np.zeros(len(x), np.int8)
        if not len(x):
            return out
        if len(self.states) > self.LIMIT:
            self.clear()
        at = np.flatnonzero(starts)
        begin = np.unique(at[np.minimum(np.searchsorted(at, np.arange(0, len(x), lane)), len(at) - 1)])
        size = np.diff(np.append(begin, len(x)))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        s, code = np.zeros(len(begin), np.int64), x.astype(np.uint16)
        code[starts] |= 256
        for p in range(int(size[0])):
            k = int(np.searchsorted(-size, -p, side="left"))
            pos = begin[:k] + p
            b = code[pos]
            key = np.where(b >= 256, b & 255, s[:k] * 256 + b)
            got = self.step[key]
            if got.min() < 0:
                for miss in np.unique(key[got < 0]).tolist():
                    self.add(miss >> 8, miss & 255)
                got = self.step[key]
            out[pos] = (got & 63) - 32
            s[:k] = got >> 6
        return out


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary's JSON."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts tokens of texts by the vocabulary file's byte-level BPE."""

    BATCH = 6_000_000

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to = byte_characters()
        names = spec["model"]["vocab"]
        tokens: list[bytes] = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            tokens[i] = bytes(to[c] for c in name) if all(c in to for c in name) else b""
        merges, made = {}, {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges[names[a], names[b]] = rank
            made.setdefault(names[a + b], (names[a], names[b], rank))
        self.special = [t["content"] for t in spec["added_tokens"]]
        for s in self.special:
            tokens = [t if t != s.encode() else b"" for t in tokens]
        self.cutter, self.merger = Cutter(), Merger(tokens, merges, made)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; special strings inside texts are one token each."""
        pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            parts = [t]
            for s in self.special:
                if s in t:
                    cut = [p.split(s) for p in parts]
                    extra[i] += sum(len(c) - 1 for c in cut)
                    parts = [p for c in cut for p in c]
            pieces += parts
            owner += [i] * len(parts)
        big = "".join(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        classes = self.cutter.classes[np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)]
        flags = self.cutter.starts(classes, lengths)
        x = np.frombuffer(big.encode("utf-8", "surrogatepass"), np.uint8)
        first = np.flatnonzero((x & 0xC0) != 0x80)
        starts = np.zeros(len(x), bool)
        starts[first[flags]] = True
        total = np.append(0, np.cumsum(self.merger.changes(x, starts), dtype=np.int64))
        ends = np.cumsum(lengths)
        edge = np.append(first, len(x))
        per = total[edge[ends]] - total[edge[ends - lengths]]
        return extra + np.bincount(np.array(owner, np.int64), weights=per, minlength=len(texts)).astype(np.int64)

    def batches(self, texts: list[str | None]) -> np.ndarray:
        """count() over batches of bounded size (a longer text is a batch of its own)."""
        out, part, size = [], [], 0
        for t in texts:
            t = t or ""
            if part and size + len(t) > self.BATCH:
                out.append(self.count(part))
                part, size = [], 0
            part.append(t)
            size += len(t)
        if part:
            out.append(self.count(part))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The process's compiled transducers for a vocabulary file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    No shuffle: the text column is read, counted in its task and dropped there.
    """
    kind = docs.schema[id_column].dataType
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            text = batch.column("text")
            n = c.batches(text.to_pylist())
            size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE_SQL: dict[str, str] = {}
