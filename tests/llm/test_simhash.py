import os
import random

import numpy as np
import xxhash

from seamline.llm import simhash
from seamline.llm.shared import shared_folder


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    texts = ["", None, " \n\t", "One", "a b c", "a b c d", "É A b\x0bc\x85d"]
    texts += [" ".join(rng.choice("ab Cd eF é 汉字 x".split()) for _ in range(rng.randrange(60))) for _ in range(200)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_trie_pairs_match_brute_force():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fp = np.array([base[rng.integers(30)] ^ np.uint64(sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 7))})) for _ in range(500)], np.uint64)
    for parts in (1, 2):
        part = np.full(500, 2) if parts == 1 else rng.integers(0, 2, 500)
        key = rng.integers(0, 3, 500)
        o = np.lexsort((fp, part, key))
        k, p, f = key[o], part[o], fp[o]
        got = {tuple(sorted(x)) for i, j in simhash.trie_pairs(k, p, f, 4, small=4) for x in zip(i.tolist(), j.tolist())}
        want = {(i, j) for j in range(500) for i in range(j) if k[i] == k[j] and (p[i] == 2 or p[i] != p[j]) and int(f[i] ^ f[j]).bit_count() <= 4}
        assert got == want


def test_query_matches_brute_force_with_odd_rows(spark):
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = [(0, None), (1, ""), (2, "  "), (3, "solo"), (4, "solo")]
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(rng.randrange(1, 5)):
            w = list(words)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    for most in (1024, 3):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, most=most).collect()}
        fps = [brute_fingerprint(t) for _, t in rows]
        want = {i: (f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute_classes(fps))}
        assert got == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect()) == [("7", 7), ("7", 7), ("None", 7)]


def test_prefixes_hold_a_whole_choice_of_blocks_for_every_pair_within_the_budget():
    rng = np.random.default_rng(8)
    for count, n in ((1000, 5), (10**8, 15), (10**10, 35)):
        turns = simhash.prefixes(4, count, 1024)
        assert len(turns) == n
        fp = rng.integers(0, 2**63, 50).astype(np.uint64)
        for x in fp.tolist():
            y = x
            for b in rng.choice(64, 4, replace=False).tolist():
                y ^= 1 << b
            assert any(all((x ^ y) >> (64 - b) & ((1 << (b - a)) - 1) == 0 for a, b in blocks) for blocks in turns)
        for blocks in turns[:3]:
            spun = simhash.turned(fp, blocks)
            assert np.bitwise_count(spun).tolist() == np.bitwise_count(fp).tolist()
            width = sum(b - a for a, b in blocks)
            want = 0
            for a, b in blocks:
                want = want << (b - a) | int(fp[0]) >> (64 - b) & ((1 << (b - a)) - 1)
            assert int(spun[0]) >> (64 - width) == want


def jaccard(a, b):
    from collections import Counter

    x, y = (Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) for w in (a, b))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def test_similar_classes_match_all_pairs_by_brute_force(spark):
    import random

    rng = random.Random(9)
    words = lambda n: ["w%d" % rng.randrange(10**5) for _ in range(n)]
    docs = {0: [], 1: [], 2: ["a", "b"], 3: ["A", "B"], 4: ["a"]}
    for k in range(60):
        base = words(rng.randrange(20, 200))
        for n in range(rng.randrange(1, 5)):
            w = list(base)
            for at in sorted(rng.sample(range(len(w)), min(len(w) // 40, n * 2)), reverse=True):
                w[at : at + 1] = rng.choice([[], ["x%d" % rng.randrange(10**6)], [w[at], "y"]])
            docs[len(docs)] = w
    low = {i: [x.lower() for x in w] for i, w in docs.items()}
    root = {i: i for i in docs}
    for a in docs:
        for b in range(a):
            if (not low[a] and not low[b]) or (low[a] and low[b] and jaccard(low[a], low[b]) >= 0.8):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    rows = [(i, " ".join(w) if w else (None if i else ""), 1) for i, w in docs.items()]
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string, node int")).collect()}
    assert len(set(root.values())) < len(root) - 30
    assert sum(got[i] != root[i] for i in docs) <= len(docs) // 50  # the chance of no common block
    assert all(root[c] == root[i] for i, c in got.items())  # nothing is joined that is not similar


def test_similar_classes_of_null_ids_repeated_ids_and_empty_tables(spark):
    text = " ".join("t%d" % i for i in range(40))
    docs = spark.createDataFrame([(None, text), (5, text), (5, "other words here"), (7, text + " end")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id) for r in simhash.similar_classes(docs).collect()) == [("5", 5), ("5", 5), ("7", 5), ("None", 5)]
    assert simhash.similar_classes(docs.limit(0)).count() == 0


def test_similar_classes_leave_only_their_result_and_links_in_the_shared_folder(spark):
    rng = random.Random(11)
    base = ["w%d" % rng.randrange(5_000) for _ in range(60)]
    docs = [(k, " ".join([*base[:k], "other%d" % k, *base[k + 1 :]])) for k in range(30)]
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    rows = simhash.similar_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in rows} == {0}
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert "seamline-similar-classes" in left
    assert not left & {"seamline-sketches", "seamline-nodes", "seamline-known", "seamline-shingle-sets", "seamline-members", "seamline-classes"}


def test_a_near_text_behind_nearer_unlike_ones_is_still_joined(spark):
    """Groups of texts around one base, most pairs just below 0.8: no link is lost beside the nearest."""
    import random

    rng = random.Random(23)
    docs = {}
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(120)]
        for n in range(60):
            w = list(base)
            for at in rng.sample(range(0, 120, 5), 2):
                w[at] = f"x{g}.{n}.{at}"
            docs[len(docs)] = w
    root = {i: i for i in docs}
    pairs = [(a, b) for a in docs for b in range(a) if a // 60 == b // 60 and jaccard(docs[a], docs[b]) >= 0.8]
    for a, b in pairs:
        x, y = sorted((root[a], root[b]))
        root = {i: x if r == y else r for i, r in root.items()}
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()}
    assert all(root[c] == root[i] for i, c in got.items())
    lost = [(a, b) for a, b in pairs if got[a] != got[b]]
    print("pairs", len(pairs), "lost", len(lost), "classes", len(set(root.values())))
    assert len(lost) <= len(pairs) // 100


def test_nearest_partners():
    import numpy as np

    kept, full = simhash.nearest_partners([[np.array([4, 4, 7]), np.array([1, 2, 3]), np.array([9, 8, 5])], [np.array([4]), np.array([0]), np.array([8])]], 2)
    assert [x.tolist() for x in kept] == [[4, 4, 7], [0, 2, 3], [8, 8, 5]] and full.tolist() == [4]


def test_pairs_at_the_similarity_stay_within_the_limits_of_differing_bits():
    rng = np.random.default_rng(3)
    for shared, left, right in [(4, 0, 1), (4, 1, 0), (8, 1, 1), (8, 0, 2), (12, 1, 2), (60, 7, 8), (80, 10, 10), (400, 0, 100), (400, 50, 50), (1600, 200, 200)]:
        small = shared + min(left, right) < simhash.SMALL
        for prints in (8, 16):
            over = 0
            for _ in range(200):
                x = np.unique(rng.integers(0, 1 << 32, shared + left + right, dtype=np.uint32))
                a, b = x[: shared + left], np.append(x[:shared], x[shared + left :])
                d = np.bitwise_count((simhash.wide_fingerprint(a, prints) ^ simhash.wide_fingerprint(b, prints)).view(np.uint64)).sum()
                over += d > simhash.most_differing(0.8, prints * simhash.BITS, small)
            assert over <= 1, (shared, left, right, prints, over)
