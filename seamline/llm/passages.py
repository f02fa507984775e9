"""Near-duplicate passages by compact windows (operator 8).

A text is its sequence of five-word shingles (words lower-cased A-Z). Passages of
`least` words or more, that is t = least - 4 shingles, are looked for; two are
similar from a multiset Jaccard similarity of `similarity` on.

1. Compact windows. A token is a span of several shingles in a row. The spans that
   are the least hash of some spans in a row are the nodes of the Cartesian tree
   with subtrees that long; node c with its subtree [l, r] stands for all
   subsequences within [l, r] that hold c: their min-hash is that of c. Span and
   subtree are as long as the shortest run of equal shingles that two similar
   passages must share (21 shingles for 50 words and 0.8: each break in a run
   costs eight shingles or more on the two sides together, see shortest_run()),
   so two similar passages have a window in common for certain, by one hash
   function. `hashes` can ask for more of them; they add nothing here.
2. Windows with the same (function, min-hash) are a group. Windows of a group with
   equal content (all shingles that a passage around c could hold) are an exact
   repeat: each meets the first of them. The leads (one window for each content)
   meet each other if there are at most `few` contents. In larger groups rows must not
   grow with the square of the group: each meets the first lead, the one before it, the
   first with the same shingles before c, and the first with the same behind c. Besides,
   the leads' shingles are fetched and held against each other by hash, in a task for
   each group: leads that share enough shingles of t in a row around c are joined,
   directly or through others (see alike()).
3. Interval join. Windows that meet at offset d = c - c' give the interval where
   both lie; intervals of the same two documents and offset are merged.
4. Verification. Exact repeats need none beyond their 64-bit content hashes. Of the
   other intervals the shingles are fetched from the texts, in one pass, and a
   stretch counts where every t in a row share enough shingles with the other
   side and the stretches' Jaccard similarity is `similarity` or more. The other
   side is the hull of what is shared; if the source has parts of it again and
   the hull is not similar, what stands near the interval's offset; and equal
   runs of t or more count in any case.

Every exact repeat of t shingles is found, and every similar one in groups of at most
`few` contents. In larger groups similar ones of t shingles that share enough are found as a
row or as a chain of rows, so that their documents are in one class. Not certain there: passages whose
other side has a longer break than t shingles may have (similar only as a whole), and those that repeat
their own shingles, where a link of the chain may fail its verification.

Hot keys: keys that hold over 1 / 4096 of the windows in a sample of documents
(fewer than 4096 keys) are dealt into parts, and a group that is longer than
`held` rows is cut into parts while it is read. Parts only change where work is
done: all leads of such keys are held against each other. Keys with more leads than a task
should hold are dealt into parts of which each meets each other.

Null, empty and short texts (fewer than `least` words) have no passages. Texts may
be of any length. Ids must be integers (else TypeError); equal ids are one
document whose windows do not meet each other; null ids are left out, as a
passage is reported by id. Extra columns are ignored; an empty table gives an
empty result. Of a document's windows with equal content the first stands for
all. Repeats within one document are not reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from seamline.llm.shared import erased, salted_join, table, written

SIZE = 5
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the five-word shingles of a text (none if it has fewer words)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - SIZE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.fromiter(map(digest, words), np.uint64, len(words))
    return mixed(sum((w[j : n + j] * FACTORS[j] for j in range(SIZE)), np.zeros(n, np.uint64)))


def sliding(x: np.ndarray, t: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every t in a row, by running picks in blocks of t."""
    n = len(x)
    pad = np.full(-n % t, x[-1], x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, t)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - t + 1], ahead[t - 1 : n])


def compact_windows(h: np.ndarray, t: int) -> list[tuple[int, int, int]]:
    """(c, l, r) of window_arrays()."""
    return list(zip(*(x.tolist() for x in window_arrays(h, t))))


def window_arrays(h: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays c, l, r: c is the first minimum of every stretch in [l, r] that holds it;
    all such with r - l + 1 >= t."""
    n = len(h)
    if n < t:
        return (np.zeros(0, np.int64),) * 3
    least = sliding(h, t, np.minimum)
    edge = np.zeros(t - 1, h.dtype)
    c = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), t, np.maximum) == h)
    # the places among c of the nearest smaller values on either side (an equal one before counts as smaller)
    left, right, stack, held = [-1] * len(c), [len(c)] * len(c), [], []
    for i, v in enumerate(h[c].tolist()):
        while held and held[-1] > v:
            held.pop()
            right[stack.pop()] = i
        if stack:
            left[i] = stack[-1]
        stack.append(i)
        held.append(v)
    ends_ = np.concatenate([c, [n, -1]])  # place len(c): behind all; place -1: before all
    l, r = ends_[left] + 1, ends_[right] - 1
    keep = r - l + 1 >= t
    return c[keep], l[keep], r[keep]


def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each of a is in b (neither empty)."""
    s = np.sort(b)
    return s[np.minimum(np.searchsorted(s, a), len(s) - 1)] == a


def runs_of(x: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the runs of true values."""
    padded = np.zeros(len(x) + 2, bool)
    padded[1:-1] = x
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def dense(shared: np.ndarray, t: int, need: int) -> list[tuple[int, int]]:
    """[lo, hi): where every t in a row share `need` or more, without unshared ends."""
    total = np.append(0, np.cumsum(shared))
    good = total[t:] - total[:-t] >= need
    out = []
    for lo, hi in runs_of(good) if good.any() else ():
        on = np.flatnonzero(shared[lo : hi + t - 1])
        out.append((lo + int(on[0]), lo + int(on[-1]) + 1))
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity as multisets."""
    if np.array_equal(a, b):
        return 1.0
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both)


def shortest_run(t: int, similarity: float) -> int:
    """A run of equal shingles that two similar passages of t or more share at least.

    Passages of a and b shingles share s >= similarity * (a + b) / (1 + similarity);
    where a run breaks, eight shingles or more of both together are not shared."""
    out = t
    for both in range(2 * t, 40 * t):
        s = int(np.ceil(similarity * both / (1 + similarity) - 1e-9))
        if both >= 2 * s:
            out = min(out, -(-s // ((both - 2 * s) // 8 + 1)))
    return max(out, 1)


def agreeing(a: np.ndarray, b: np.ndarray, t: int, similarity: float, *offs: int) -> Iterator[tuple[int, int, int, int, float]]:
    """(from, to, from, to, similarity): stretches of a and b that agree; a[i] was met
    at b[i + off] for each off given (0 if none).

    A stretch of a is held against the hull of what it shares with b; if that is not
    similar (b has a part of it again elsewhere), against what stands near its own
    place; and if that is not either, its equal runs of t or more count."""
    need = int(np.ceil(2 * similarity * t / (1 + similarity) - 1e-9))
    if len(a) < t or len(b) < t:
        return
    for lo, hi in dense(within(a, b), t, need):
        on = np.flatnonzero(within(b, a[lo:hi]))
        b_lo, b_hi = int(on[0]), int(on[-1]) + 1
        most = min(hi - lo, len(on))
        # no more than `most` can be shared
        s = jaccard(a[lo:hi], b[b_lo:b_hi]) if most >= similarity * (hi - lo + b_hi - b_lo - most) else 0.0
        if s >= similarity:
            if min(hi - lo, b_hi - b_lo) >= need:
                yield lo, hi, b_lo, b_hi, s
            continue
        yield from elsewhere(a, b, t, similarity, lo, hi, offs)


def elsewhere(a: np.ndarray, b: np.ndarray, t: int, similarity: float, lo: int, hi: int, offs: tuple[int, ...]) -> Iterator[tuple[int, int, int, int, float]]:
    """agreeing() for a stretch of a whose hull in b is not similar."""
    lo, hi = max(lo - t, 0), min(hi + t, len(a))
    open_ = np.ones(hi - lo, bool)
    for first, last in bands(sorted(offs or (0,)), t - int(similarity * t) + 1):
        for x, y, p, q, s in near_place(a, b, t, similarity, first, last, lo, hi):
            open_[x - lo : y - lo] = False
            yield x, y, p, q, s
        # where a passage of a is found already, other places of b need not be looked at
        if not dense(open_, t, t):
            break


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all ranges [lo, hi) in a row, and which range each is of."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(of)) + (lo - np.cumsum(size) + size)[of], of


def hulls(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, t: int, similarity: float) -> tuple[np.ndarray, ...]:
    """(pair, from, to, from, to, similarity) of the stretches of many pairs that agreeing() holds
    against their hulls first; pair k is a[a_at[k] : a_at[k + 1]] and b[b_at[k] : b_at[k + 1]]."""
    need = int(np.ceil(2 * similarity * t / (1 + similarity) - 1e-9))
    n = len(a_at) - 1
    a, b, a_at, b_at = a[a_at[0] : a_at[-1]], b[b_at[0] : b_at[-1]], a_at - a_at[0], b_at - b_at[0]
    of_a, of_b = np.repeat(np.arange(n), np.diff(a_at)), np.repeat(np.arange(n), np.diff(b_at))
    salt = mixed(np.arange(1, n + 1, dtype=np.uint64))
    ids = np.unique(np.concatenate([a.view(np.uint64) ^ salt[of_a], b.view(np.uint64) ^ salt[of_b]]), return_inverse=True)[1]
    a, b, count = ids[: len(a)], ids[len(a) :], int(ids.max(initial=-1)) + 1
    shared = np.bincount(b, minlength=count)[a] > 0
    total, good = np.append(0, np.cumsum(shared)), np.zeros(len(a), bool)
    at = np.flatnonzero((np.arange(len(a)) + t <= a_at[1:][of_a]) & (np.diff(b_at)[of_a] >= t))
    good[at] = total[at + t] - total[at] >= need
    new = np.append(of_a[1:] != of_a[:-1], True) if len(a) else good
    lo = np.flatnonzero(good & ~(np.append(False, good[:-1] & ~new[:-1])[: len(a)]))
    hi = np.flatnonzero(good & ~(np.append(good[1:] & ~new[:-1], False)[: len(a)])) + t
    on = np.flatnonzero(shared)
    pair, lo, hi = of_a[lo], on[np.searchsorted(on, lo)], on[np.searchsorted(on, hi) - 1] + 1
    b_lo, b_hi, s = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64), np.zeros(len(lo))
    # a pair's first stretches at once, then the second ones, as ids are those of a pair
    turn = np.arange(len(pair)) - np.searchsorted(pair, pair)
    for k in range(int(turn.max(initial=-1)) + 1):
        i = np.flatnonzero(turn == k)
        mine, of_mine = spread(lo[i], hi[i])
        theirs, of_theirs = spread(b_at[pair[i]], b_at[pair[i] + 1])
        n_a = np.bincount(a[mine], minlength=count)
        hit = np.flatnonzero(n_a[b[theirs]] > 0)
        first, end = np.searchsorted(of_theirs[hit], np.arange(len(i))), np.searchsorted(of_theirs[hit], np.arange(len(i)), side="right")
        b_lo[i], b_hi[i] = theirs[hit[first]], theirs[hit[end - 1]] + 1
        inside = (theirs >= b_lo[i][of_theirs]) & (theirs < b_hi[i][of_theirs])
        n_b = np.bincount(b[theirs[inside]], minlength=count)
        own = np.zeros(count, np.int64)
        own[a[mine]] = of_mine
        some = np.flatnonzero(n_a)
        both = np.bincount(own[some], np.minimum(n_a, n_b)[some], len(i))
        s[i] = both / (hi[i] - lo[i] + b_hi[i] - b_lo[i] - both)
    return pair, lo - a_at[pair], hi - a_at[pair], b_lo - b_at[pair], b_hi - b_at[pair], s


def bands(offs: list[int], slack: int) -> Iterator[tuple[int, int]]:
    """The offsets as ranges of at most 2 * slack, widened by slack."""
    k = 0
    while k < len(offs):
        first = last = offs[k]
        while k < len(offs) and offs[k] <= first + 2 * slack:
            last = offs[k]
            k += 1
        yield first - slack, last + slack


def near_place(a: np.ndarray, b: np.ndarray, t: int, similarity: float, first: int, last: int, lo: int, hi: int) -> Iterator[tuple[int, int, int, int, float]]:
    """agreeing() for a[lo:hi], where b is only looked at with offsets from first to last."""
    need = int(np.ceil(2 * similarity * t / (1 + similarity) - 1e-9))
    # at[k, i]: whether a[lo + i] stands in b at its place, shifted by first + k
    padded = np.concatenate([np.zeros(len(a) + max(-first, 0), b.dtype), b, np.zeros(len(a) + max(last, 0), b.dtype)])
    zero = len(a) + max(-first, 0)
    views = np.lib.stride_tricks.sliding_window_view(padded[zero + lo + first : zero + hi + last], hi - lo)
    at = views == a[lo:hi]
    for x, y in dense(at.any(axis=0), t, need):
        k, i = np.nonzero(at[:, x:y])
        spots = k + i + (lo + first + x)
        b_lo, b_hi = int(spots.min()), int(spots.max()) + 1
        # of two lengths, no more than the shorter one can be shared
        s = jaccard(a[lo + x : lo + y], b[b_lo:b_hi]) if min(y - x, b_hi - b_lo) >= similarity * max(y - x, b_hi - b_lo) else 0.0
        if s >= similarity and min(y - x, b_hi - b_lo) >= need:
            yield lo + x, lo + y, b_lo, b_hi, s
            continue
        rows = np.flatnonzero(at[:, x:y].sum(axis=1) >= t)
        # the runs of all rows at once, each row ended by a false value
        flat = np.zeros((len(rows), y - x + 1), bool)
        flat[:, :-1] = at[rows, x:y]
        for u, v in runs_of(flat.ravel()):
            if v - u >= t:
                k, u, v = int(rows[u // (y - x + 1)]), u % (y - x + 1) + lo + x, v - u + u % (y - x + 1) + lo + x
                yield u, v, u + first + k, v + first + k, 1.0


@lru_cache(maxsize=12)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of BASE and of INVERSE, from 0 on."""
    return tuple(np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))) for x in (BASE, INVERSE))


def hashed_runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What content() needs: prefix sums of h times powers of BASE, and the inverse powers."""
    up, down = powers(1 << len(h).bit_length())
    up, down = up[: len(h) + 1], down[: len(h) + 1]
    return np.append(np.uint64(0), np.cumsum(h * up[:-1], dtype=np.uint64)), down


def content(runs: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [a, b), equal for equal contents wherever they stand."""
    prefix, down = runs
    return mixed((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64))


#: A window: key, part of a hot key (-1: not hot), hash of its content, 16 bits each of the hashes of what is before and behind c (these only choose whom it meets), and its spot: c, how far its start is from c and how far its end (16 bits each; further than a passage around c can reach is of no use)
WINDOW = "key long, part int, around long, sides int, doc_id long, spot long"
NAMES = [x.split()[0] for x in WINDOW.split(", ")]


def windows(docs: DataFrame, t: int, run: int, hashes: int) -> DataFrame:
    """All compact windows of documents (columns: see WINDOW)."""
    span = (run + 1) // 2
    low = lambda x: x & np.uint64(0xFFFF)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                h = shingles(text.as_py())
                n = len(h)
                if n < t:
                    continue
                runs, at = hashed_runs(h), np.arange(n - span + 1)
                g = content(runs, at, at + span)
                for k in range(hashes):
                    tokens = g if not k else mixed(g ^ np.uint64(k * 0x5851F42D4C957F2D & 2**64 - 1))
                    c, l, r = window_arrays(tokens, run - span + 1)
                    lo, hi = np.maximum(c - (t - span), 0), np.minimum(c + t, n)
                    # how far c is from the start belongs to the content
                    three = content(runs, np.concatenate([lo, np.maximum(c - span + 1, 0), c + span]), np.concatenate([hi, c, np.minimum(c + 2 * span - 1, n)])).reshape(3, -1)
                    around = mixed(three[0] + (c - lo).astype(np.uint64))
                    one = np.unique(around, return_index=True)[1]
                    c, l, r, around = c[one], l[one], r[one], around[one]
                    before, behind = three[1:, one]
                    ids.append(np.full(len(c), doc, np.int64))
                    sides = (low(before) << np.uint64(16) | low(behind)).astype(np.uint32).view(np.int32)
                    spot = c << 32 | np.minimum(c - l, t - span) << 16 | np.minimum(r + span - c, t)
                    parts.append(((tokens[c] ^ np.uint64(k)).view(np.int64), around.view(np.int64), sides, spot))
            empty = [np.zeros(0, d) for d in (np.int64, np.int64, np.int32, np.int64)]
            key, around, sides, spot = [np.concatenate(x) for x in zip(*parts)] if parts else empty
            doc = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, np.full(len(key), -1, np.int32), around, sides, doc, spot)], NAMES)

    return docs.mapInArrow(cut, WINDOW)


def dealt(found: DataFrame, sample: DataFrame, share: int = 4096) -> DataFrame:
    """found with parts for the keys that hold over 1 / share of the sample."""
    counts = sample.groupBy("key").count()
    counts = written(counts.where("count > 1"), "sampled-keys")
    n = sample.count()
    # fewer than `share` keys can hold over 1 / share of the rows
    hot = counts.where(F.col("count") > max(8, n // share)).select(F.col("key").alias("hot"), F.ceil(F.col("count") / max(8, n // share)).cast("int").alias("parts"))
    out = found.join(F.broadcast(hot), F.col("key") == F.col("hot"), "left")
    return out.withColumn("part", F.coalesce(F.pmod(F.hash("doc_id"), F.col("parts")), F.lit(-1))).select(*NAMES)


def first_of(*columns: np.ndarray) -> np.ndarray:
    """For each row, the first row with the same values in the columns."""
    order = np.lexsort(columns[::-1])  # stable, so the first row of equal ones leads
    new = np.append(True, np.any([x[order][1:] != x[order][:-1] for x in columns], axis=0))
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


#: How two windows meet: by equal content, otherwise; and what is no link: a lead whose shingles are to be held against those of the others of its key
EXACT, NEAR, LEAD = range(3)
LINK = "kind int, key long, doc_id long, spot long, other_id long, other_spot long"


def linked(found: DataFrame, few: int = 6, held: int = 400_000) -> DataFrame:
    """Who meets whom within each key and part (columns: see LINK; of LEAD the other side is
    the window itself; other kinds' keys are 0)."""

    def links(rows: list[np.ndarray], whole: bool) -> pa.RecordBatch:
        """Links within rows of whole keys and parts (whole: the last one does not go on)."""
        key, part, around, sides, doc, spot = rows
        n = len(key)
        group = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))
        g, start = np.cumsum(group) - 1, np.flatnonzero(group)
        lead = group | np.append(True, around[1:] != around[:-1])
        first = np.maximum.accumulate(np.where(lead, np.arange(n), 0))
        several = (np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start))[g]
        broken = part >= 0
        if not whole:
            broken = broken | (g == g[-1])
        i = np.flatnonzero(~lead)
        out = [(EXACT, i, first[i])]
        at = np.flatnonzero(lead)
        contents = np.bincount(g[at], minlength=len(start))[g[at]]
        rank = np.arange(len(at)) - np.flatnonzero(group[at])[g[at]]
        small = several[at] & (contents <= few)
        for back in range(1, few):
            i = np.flatnonzero(small & (rank >= back))
            out.append((NEAR, at[i], at[i - back]))
        large = np.flatnonzero(several[at] & (contents > few) & (rank > 0))
        if len(large):
            at_, g_ = at[large], g[at[large]]
            for to in (start[g_], at[large - 1], at_[first_of(g_, sides[at_] >> 16)], at_[first_of(g_, sides[at_] & 0xFFFF)]):
                out.append((NEAR, at_, to))
        out.append((LEAD, *[at[((contents > few) & several[at]) | broken[at]]] * 2))
        kind = np.concatenate([np.full(len(i), k, np.int32) for k, i, _ in out])
        i, j = (np.concatenate([x[m] for x in out]) for m in (1, 2))
        keep = (doc[i] != doc[j]) | (kind == LEAD)
        kind, i, j = kind[keep], i[keep], j[keep]
        # the source is the document with the smaller id
        i, j = np.where(doc[i] < doc[j], j, i), np.where(doc[i] < doc[j], i, j)
        one = np.unique(np.stack([kind, i, j]), axis=1)
        kind, i, j = one[0].astype(np.int32), one[1], one[2]
        table = [kind, np.where(kind == LEAD, key[i], 0), doc[i], spot[i], doc[j], spot[j]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in table], [x.split()[0] for x in LINK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            rows = [np.asarray(batch.column(k)) for k in range(len(NAMES))]
            kept = [np.concatenate([h, r]) for h, r in zip(kept, rows)] if kept else rows
            if len(kept[0]) < 50_000:
                continue
            # the last group may go on
            same = (kept[0] == kept[0][-1]) & (kept[1] == kept[1][-1])
            cut = len(same) - int(same.sum())
            if cut:
                yield links([x[:cut] for x in kept], True)
                kept = [x[cut:] for x in kept]
            elif len(same) > held:
                yield links(kept, False)
                # what follows of this key is a part of its own; its first row stays, as part of a hot key
                kept = [np.maximum(x[-1:], 0) if k == 1 else x[-1:] for k, x in enumerate(kept)]
        if kept and len(kept[0]):
            yield links(kept, True)

    order = ["key", "part", "around", "doc_id", "spot"]
    return found.repartition("key", "part").sortWithinPartitions(*order).mapInArrow(run, LINK)


def alike(group: np.ndarray, doc: np.ndarray, h: np.ndarray, before: np.ndarray, behind: np.ndarray, t: int, span: int, run: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a group that share `need` of t shingles in a row around c, such that all
    those pairs are joined, directly or through others. h: the shingles of [c - t + span, c + t), of which `before` before c and
    `behind` from c on are there.

    Shingles that are not shared stand in a row of SIZE - 1 or more, so two such rows
    have a run of `need` around c in common, or a run of `run` or more around c and, behind or before a
    break of t - need at most, another; `need` together. These are compared by hash, for every
    place of the runs; a longer first run is only tried where rows of different trees share the
    shorter one. If t has room for two breaks, all pairs with a common run are taken."""
    n, at = len(group), t - span
    prefix = np.zeros((h.shape[1] + 1, n), np.uint64)
    power = [pow(BASE, k, 2**64) for k in range(h.shape[1])]
    for k, x in enumerate(power):
        prefix[k + 1] = prefix[k] + (h[:, k].astype(np.uint64) + np.uint64(1)) * np.uint64(x)
    group = mixed(group.view(np.uint64) ^ np.uint64(BASE))
    root, out = np.arange(n), [np.zeros((2, 0), np.int64)]

    def hashed(rows: np.ndarray, a: int, b: int) -> np.ndarray:
        return mixed((prefix[b, rows] - prefix[a, rows]) * np.uint64(pow(INVERSE, a, 2**64)) + np.uint64(b - a))

    def there(rows: np.ndarray, a: int, b: int) -> np.ndarray:
        return rows[(before[rows] >= at - a) & (behind[rows] >= b - at)] if 0 <= a and b <= h.shape[1] else rows[:0]

    def classes(key: np.ndarray, rows: np.ndarray, again: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """rows in order of their keys, where those of each key start, and which of them several trees and documents have."""
        # sorting numbers that end in their places is quicker than sorting places; where the rest of the bits is not enough, places it is
        low = np.uint64((1 << len(key).bit_length()) - 1)
        packed = np.sort(key & ~low | np.arange(len(key), dtype=np.uint64))
        order = (packed & low).astype(np.int64)
        if np.any(((packed[1:] ^ packed[:-1]) <= low) & (key[order[1:]] != key[order[:-1]])):
            order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        several = np.ones(len(start), bool)
        for x in (doc[rows],) if again else (root[rows], doc[rows]):
            several &= np.minimum.reduceat(x, start) != np.maximum.reduceat(x, start)
        keep = np.repeat(several, np.diff(np.append(start, len(rows))))
        return rows[keep], np.flatnonzero(np.append(True, key[keep][1:] != key[keep][:-1])) if keep.any() else start[:0], order[keep]

    def join(key: np.ndarray, rows: np.ndarray, again: bool = False) -> None:
        """Each row meets the first one of its key; rows of that one's document the first one of another.
        again: also where both are in one tree."""
        if not len(rows):
            return
        rows, start, _ = classes(key, rows, again)
        if not len(rows):
            return
        size = np.diff(np.append(start, len(rows)))
        first = np.repeat(start, size)
        other = doc[rows] != doc[rows[first]]
        second = np.repeat(np.minimum.reduceat(np.where(other, np.arange(len(rows)), len(rows)), start), size)
        i, j = rows, rows[np.where(other, first, second)]
        new = (i != j) & (again | (root[i] != root[j]))
        x, y = i[new], j[new]
        out.append(np.stack([x, y]))
        while len(x):
            a, b = root[x], root[y]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root]).tobytes() != root.tobytes():
                root[:] = up
            live = root[x] != root[y]
            x, y = x[live], y[live]

    every = np.arange(n)
    if t - need >= 2 * (SIZE - 1):
        for x in range(run - span + 1):
            rows = there(every, at - x, at - x + run)
            if len(rows):
                rows, start, _ = classes(hashed(rows, at - x, at - x + run) ^ group[rows], rows)
                for a, b in zip(start, np.append(start[1:], len(rows))):
                    out += [np.stack([np.full(b - k - 1, rows[k]), rows[k + 1 : b]]) for k in range(a, b - 1)]
        pairs = np.unique(np.concatenate(out, axis=1), axis=1)
        return tuple(pairs[:, doc[pairs[0]] != doc[pairs[1]]])
    for x in range(need - span + 1):
        rows = there(every, at - x, at - x + need)
        join(hashed(rows, at - x, at - x + need) ^ group[rows], rows, True)
    for y in range(span, need):
        rows = every
        for x in range(max(0, run - y), need - y):
            rows = there(rows, at - x, at + y)
            if not len(rows):
                break
            key = hashed(rows, at - x, at + y) ^ group[rows]
            rows, _, order = classes(key, rows)
            if not len(rows):
                break
            rest, keys, spots = need - x - y, [], []
            base = np.zeros(n, np.uint64)
            base[rows] = key[order]
            for gap in range(SIZE - 1, t - need + 1):
                for a in (at + y + gap, at - x - gap - rest):
                    some = there(rows, a, a + rest)
                    keys.append(mixed(base[some] + hashed(some, a, a + rest)))
                    spots.append(some)
            join(np.concatenate(keys), np.concatenate(spots))
    return tuple(np.unique(np.concatenate(out, axis=1), axis=1))


def met(docs: DataFrame, leads: DataFrame, t: int, run: int, similarity: float, most: int = 16_384) -> DataFrame:
    """Links (columns: see LINK) between leads (key, doc_id, spot) of equal keys, by alike()."""
    need = int(np.ceil(2 * similarity * t / (1 + similarity) - 1e-9))
    span = (run + 1) // 2
    width = 2 * t - span
    names = ["key", "doc_id", "spot", "h"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                h = (shingles(batch.column("text")[k].as_py()) >> np.uint64(32)).astype(np.uint32)
                key, spot = (x.values.to_numpy() for x in (batch.column("keys")[k], batch.column("spots")[k]))
                padded = np.concatenate([np.zeros(t - span, np.uint32), h, np.zeros(t, np.uint32)])
                for m in range(0, len(key), 4096):
                    c = spot[m : m + 4096] >> 32
                    # two shorts in front: how many shingles are there before c and from c on
                    ends_ = np.stack([np.minimum(c, t - span), np.minimum(len(h) - c, t)], axis=1).astype("<u2").view("<u4")
                    rows = np.concatenate([ends_, padded[c[:, None] + np.arange(width)]], axis=1)
                    h_ = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * 4), len(c), [None, pa.py_buffer(rows.astype("<u4").tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(key[m : m + 4096]), pa.array(np.full(len(c), batch.column("doc_id")[k].as_py(), np.int64)), pa.array(spot[m : m + 4096]), h_.cast(pa.binary())], names)

    def links(rows: list) -> pa.RecordBatch:
        key, part, doc, spot, h = rows
        h = np.frombuffer(b"".join(h), "<u4").reshape(len(key), -1)
        ends_ = np.ascontiguousarray(h[:, :1]).view("<u2").astype(np.int64)
        i, j = alike(key ^ (part.astype(np.int64) * np.int64(0x5851F42D4C957F2D)), doc, h[:, 1:], ends_[:, 0], ends_[:, 1], t, span, run, need)
        # the source is the document with the smaller id
        i, j = np.where(doc[i] < doc[j], j, i), np.where(doc[i] < doc[j], i, j)
        table = [np.full(len(i), NEAR, np.int32), np.zeros(len(i), np.int64), doc[i], spot[i], doc[j], spot[j]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in table], [x.split()[0] for x in LINK.split(", ")])

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            rows = [*(np.asarray(batch.column(c)) for c in ("key", "part", "doc_id", "spot")), batch.column("h").to_pylist()]
            held = [np.concatenate([x, y]) for x, y in zip(held[:4], rows[:4])] + [held[4] + rows[4]] if held else rows
            n = len(held[0])
            if n < most:
                continue
            # the last group may go on
            cut = n - int(((held[0] == held[0][-1]) & (held[1] == held[1][-1])).sum())
            if cut >= most // 2:
                yield links([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held and len(held[0]):
            yield links(held)

    of = leads.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("key").alias("keys"), F.collect_list("spot").alias("spots"))
    read_ = docs.join(of, F.col("doc_id") == F.col("id")).select("doc_id", "text", "keys", "spots").mapInArrow(read, "key long, doc_id long, spot long, h binary")
    # keys with more leads than a task should hold: each part of them meets each other one
    large = leads.groupBy("key").count().where(F.col("count") > 2 * most).select("key", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    dealt_ = read_.join(F.broadcast(large), "key", "left").withColumn("own", F.pmod(F.xxhash64("doc_id", "spot"), F.col("parts")).cast("int"))
    other = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("own")))
    dealt_ = dealt_.withColumn("other", F.explode(other))
    part = F.coalesce(F.least("own", "other") * F.col("parts") + F.greatest("own", "other"), F.lit(0)).alias("part")
    return dealt_.select("key", part, "doc_id", "spot", "h").repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run_, LINK)


def ends(spot: str) -> tuple:
    """c, lo and hi of a spot, for [lo, hi)."""
    c = F.shiftright(spot, 32).cast("int")
    return c, c - F.shiftright(spot, 16).bitwiseAND(65535).cast("int"), c + F.col(spot).bitwiseAND(65535).cast("int")


def merged(links: DataFrame, margin: int) -> DataFrame:
    """doc_id, other_id, d, lo, hi: the intervals where both windows lie, by offset, widened
    by the margin; overlapping ones are one."""
    (c, lo, hi), (other_c, other_lo, other_hi) = ends("spot"), ends("other_spot")
    d = c - other_c
    pairs = links.select("doc_id", "other_id", d.alias("d"), (F.greatest(lo, other_lo + d) - margin).alias("lo"), (F.least(hi, other_hi + d) + margin).alias("hi"))
    start = F.array().cast("array<struct<lo:int,hi:int>>")

    def step(acc, x):
        top = F.get(acc, F.size(acc) - 1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(top["lo"].alias("lo"), F.greatest(top["hi"], x["hi"]).alias("hi"))))
        return F.when((F.size(acc) > 0) & (x["lo"] <= top["hi"]), grown).otherwise(F.concat(acc, F.array(x)))

    spans = F.array_sort(F.collect_set(F.struct("lo", "hi")))
    return pairs.groupBy("doc_id", "other_id", "d").agg(spans.alias("s")).select("doc_id", "other_id", "d", F.explode_outer(F.aggregate("s", start, step)).alias("s")).select("doc_id", "other_id", "d", "s.*")


def clustered(intervals: DataFrame, gap: int) -> DataFrame:
    """doc_id, lo, hi, other_id, other_lo, other_hi, d: intervals of the same documents that
    are at most `gap` from each other on both sides are one, with all their offsets d."""
    start = F.array().cast("array<struct<lo:int,hi:int,other_lo:int,other_hi:int,d:array<int>>>")

    def step(acc, x):
        top, a, b = F.get(acc, F.size(acc) - 1), x["lo"] - x["d"], x["hi"] - x["d"]
        near = (x["lo"] <= top["hi"] + gap) & (a <= top["other_hi"] + gap) & (b >= top["other_lo"] - gap)
        grown = F.struct(top["lo"].alias("lo"), F.greatest(top["hi"], x["hi"]).alias("hi"), F.least(top["other_lo"], a).alias("other_lo"), F.greatest(top["other_hi"], b).alias("other_hi"), F.array_union(top["d"], F.array(x["d"])).alias("d"))
        new = F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), a.alias("other_lo"), b.alias("other_hi"), F.array(x["d"]).alias("d"))
        return F.when((F.size(acc) > 0) & near, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    every = F.array_sort(F.collect_set(F.struct("lo", "hi", "d")))
    out = intervals.groupBy("doc_id", "other_id").agg(every.alias("s")).select("doc_id", "other_id", F.explode_outer(F.aggregate("s", start, step)).alias("s"))
    return out.select("doc_id", "other_id", "s.*")


GRID = 32


def on_grid(pairs: DataFrame) -> DataFrame:
    """pairs with the slices of either side that are fetched: ends on a grid, so that many
    pairs ask for the same slice."""
    down, up = lambda c: F.greatest(F.floor(F.col(c) / GRID) * GRID, F.lit(0)).cast("int").alias(c), lambda c: (F.ceil(F.col(c) / GRID) * GRID).cast("int").alias(c)
    return pairs.select("doc_id", down("lo"), up("hi"), "other_id", down("other_lo"), up("other_hi"), "d")


def fetched(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, lo, hi, h: the shingle hashes of the slices asked for, in one pass over the texts."""
    names = ["doc_id", "lo", "hi", "h"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out = []
                for doc, text, spans in zip(*(x.to_pylist() for x in batch.slice(k, 256).columns)):
                    h = shingles(text).view(np.int64)
                    out += [(doc, s["lo"], s["hi"], h[s["lo"] : s["hi"]]) for s in spans]
                doc, lo, hi, h = zip(*out) if out else ((), (), (), ())
                slices = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in h])).astype(np.int32)), pa.array(np.concatenate(h) if h else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), slices], names)

    wanted = asked.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return docs.join(wanted, F.col("doc_id") == F.col("id")).select("doc_id", "text", "spans").mapInArrow(read, "doc_id long, lo int, hi int, h array<long>")


PASSAGE = "doc_id long, start_word long, n_words long, source_id long, source_start_word long, source_words long, similarity double"


def verified(pairs: DataFrame, slices: DataFrame, t: int, similarity: float) -> DataFrame:
    """The passages (columns: see PASSAGE) in pairs of slices."""
    mine = salted_join(pairs, slices, ["doc_id", "lo", "hi"])
    theirs = slices.select(F.col("doc_id").alias("other_id"), F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"), F.col("h").alias("g"))
    both = salted_join(mine, theirs, ["other_id", "other_lo", "other_hi"], pairs)
    names = [x.split()[0] for x in PASSAGE.split(", ")]

    need = int(np.ceil(2 * similarity * t / (1 + similarity) - 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, a_at), (b, b_at) = ((c.values.to_numpy(), c.offsets.to_numpy().astype(np.int64)) for c in (batch.column("h"), batch.column("g")))
            doc, lo, other, other_lo = (np.asarray(batch.column(c)).astype(np.int64) for c in ("doc_id", "lo", "other_id", "other_lo"))
            k = 0
            while k < batch.num_rows:
                # about as many shingles at once as the processor's caches hold
                to = k + max(1, int(np.searchsorted(a_at[k + 1 :] - a_at[k] + b_at[k + 1 :] - b_at[k], 1 << 17, side="right")))
                pair, x, y, p, q, s = hulls(a, a_at[k : to + 1], b, b_at[k : to + 1], t, similarity)
                pair += k
                fits = (s >= similarity) & (np.minimum(y - x, q - p) >= need)
                rows = [z[fits] for z in (pair, x, y, p, q, s)]
                rest = np.flatnonzero(s < similarity)
                more = []
                for m, u, v in zip(pair[rest].tolist(), x[rest].tolist(), y[rest].tolist()):
                    offs = tuple(int(lo[m]) - z - int(other_lo[m]) for z in batch.column("d")[m].as_py())
                    more += [(m, *z) for z in elsewhere(a[a_at[m] : a_at[m + 1]], b[b_at[m] : b_at[m + 1]], t, similarity, u, v, offs)]
                if more:
                    rows = [np.concatenate([z, np.array(w, z.dtype)]) for z, w in zip(rows, zip(*more))]
                pair, x, y, p, q, s = rows
                out = [doc[pair], lo[pair] + x, y - x + SIZE - 1, other[pair], other_lo[pair] + p, q - p + SIZE - 1, np.array([round(z, 6) for z in s.tolist()], np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in out], names)
                k = to

    return both.select("doc_id", "lo", "h", "other_id", "other_lo", "g", "d").mapInArrow(run, PASSAGE)


def joined(hits: DataFrame) -> DataFrame:
    """Passages of the same two documents that overlap on both sides as one, with the least
    similarity of them."""
    start = F.array().cast("array<struct<a:bigint,b:bigint,p:bigint,q:bigint,s:double>>")

    def step(acc, x):
        top = F.get(acc, F.size(acc) - 1)
        one = F.struct(top["a"].alias("a"), F.greatest(top["b"], x["b"]).alias("b"), F.least(top["p"], x["p"]).alias("p"), F.greatest(top["q"], x["q"]).alias("q"), F.least(top["s"], x["s"]).alias("s"))
        near = (x["a"] < top["b"]) & (x["p"] < top["q"]) & (x["q"] > top["p"])
        return F.when((F.size(acc) > 0) & near, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(one))).otherwise(F.concat(acc, F.array(x)))

    a, p = F.col("start_word"), F.col("source_start_word")
    every = F.array_sort(F.collect_set(F.struct(a.alias("a"), (a + F.col("n_words")).alias("b"), p.alias("p"), (p + F.col("source_words")).alias("q"), F.col("similarity").alias("s"))))
    out = hits.groupBy("doc_id", "source_id").agg(every.alias("s")).select("doc_id", "source_id", F.explode_outer(F.aggregate("s", start, step)).alias("s"))
    return out.select("doc_id", F.col("s.a").alias("start_word"), (F.col("s.b") - F.col("s.a")).alias("n_words"), "source_id", F.col("s.p").alias("source_start_word"), (F.col("s.q") - F.col("s.p")).alias("source_words"), F.col("s.s").alias("similarity"))


def repeated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 50, similarity: float = 0.8, hashes: int = 1, few: int = 6, sample: float = 0.05) -> DataFrame:
    """doc_id, start_word, n_words, source_id, source_start_word, similarity: the
    passages of a document that a document with a smaller id (the source) has too,
    and the sources' own passages (source_id = doc_id)."""
    if not isinstance(docs.schema[id_column].dataType, IntegralType):
        raise TypeError(f"{id_column} must be an integer column")
    t = least - SIZE + 1
    if not 1 <= t < 16_000:
        raise ValueError("least must be from 5 to 16,000 words")
    run = shortest_run(t, similarity)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null")
    some = windows(texts.sample(False, sample, 7), t, run, hashes)
    links = written(linked(dealt(windows(texts, t, run, hashes), written(some.select("key"), "sampled-windows")), few), "links")
    same = written(merged(links.where(F.col("kind") == EXACT), 0), "exact")
    enough = F.col("hi") - F.col("lo") >= t
    wider = same.where(~enough).select("doc_id", "other_id", "d", (F.col("lo") - t).alias("lo"), (F.col("hi") + t).alias("hi"))
    leads = written(links.where(F.col("kind") == LEAD).select("key", "doc_id", "spot").distinct(), "leads")
    more = written(met(texts, leads, t, run, similarity), "met")
    near = merged(links.where(F.col("kind") == NEAR).unionByName(more), t)
    pairs = written(on_grid(clustered(near.unionByName(wider), t)), "intervals")
    erased(links)
    asked = pairs.select("doc_id", "lo", "hi").union(pairs.select("other_id", "other_lo", "other_hi")).distinct()
    slices = written(fetched(texts, asked), "slices")
    exact = same.where(enough).select("doc_id", F.col("lo").cast("long").alias("start_word"), (F.col("hi") - F.col("lo") + SIZE - 1).cast("long").alias("n_words"), F.col("other_id").alias("source_id"), (F.col("lo") - F.col("d")).cast("long").alias("source_start_word"), (F.col("hi") - F.col("lo") + SIZE - 1).cast("long").alias("source_words"), F.lit(1.0).alias("similarity"))
    hits = written(joined(verified(pairs, slices, t, similarity).unionByName(exact)), "passages")
    own = hits.select(F.col("source_id").alias("doc_id"), F.col("source_start_word").alias("start_word"), F.col("source_words").alias("n_words"), "source_id", "source_start_word", "source_words", F.lit(1.0).alias("similarity")).distinct()
    return hits.unionByName(joined(own)).drop("source_words")


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))


QUERIES = {"op8_passages": op8_passages}
ORACLE_SQL: dict[str, str] = {}
