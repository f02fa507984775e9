import random

import numpy as np

from seamline.llm import passages as p


def test_hulls_of_many_pairs_at_once_give_what_agreeing_gives_one_by_one():
    rng = np.random.default_rng(5)
    pairs = []
    for k in range(300):
        a = rng.integers(0, 1 << 62, int(rng.integers(0, 160))).astype(np.int64)
        if k % 7 == 0 and len(a):
            a = a[rng.integers(0, max(1, len(a) // 3), len(a))]
        b = a[len(a) // 5 :].copy()
        for at in rng.integers(0, max(1, len(b)), int(rng.integers(0, 5))).tolist():
            b[at : at + 5] = rng.integers(0, 1 << 62, len(b[at : at + 5]))
        pairs.append((a, np.concatenate([rng.integers(0, 1 << 62, int(rng.integers(0, 60))), b, b[: 60 * (k % 5 == 0)]])))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    a_at, b_at = (np.append(0, np.cumsum([len(x) for x in side])) for side in zip(*pairs))
    for t in (46, 10, 1):
        need = int(np.ceil(1.6 * t / 1.8 - 1e-9))
        got = []
        for k, x, y, u, v, s in zip(*(z.tolist() for z in p.hulls(a, a_at, b, b_at, t, 0.8))):
            if s < 0.8:
                got += [(k, *z) for z in p.elsewhere(*pairs[k], t, 0.8, x, y, ())]
            elif min(y - x, v - u) >= need:
                got.append((k, x, y, u, v, s))
        assert sorted(got) == sorted((k, *z) for k, (x, y) in enumerate(pairs) for z in p.agreeing(x, y, t, 0.8))


def test_compact_windows_match_brute_force():
    rng = np.random.default_rng(14)
    for n in (0, 3, 4, 5, 17, 60):
        for high in (3, 1000):
            h = rng.integers(0, high, n).astype(np.uint64) + np.uint64(1)
            got = set(p.compact_windows(h, 4))
            want = set()
            for c in range(n):
                a = c
                while a > 0 and h[a - 1] > h[c]:
                    a -= 1
                b = c
                while b < n - 1 and h[b + 1] >= h[c]:
                    b += 1
                if b - a + 1 >= 4:
                    want.add((c, a, b))
            assert got == want


def words(rng, n):
    return ["w%d" % rng.randrange(100_000) for _ in range(n)]


def corpus(seed):
    """Texts, and for each the ids that share a passage of over 50 words with it."""
    rng = random.Random(seed)
    docs = {i: words(rng, rng.randrange(30, 200)) for i in range(60)}
    hit = set()
    for k in range(8):
        passage = words(rng, rng.randrange(51, 90))
        for i in rng.sample(range(10, 60), 3):
            w = list(passage)
            if k % 2:
                w[len(w) // 2] = "edited"
            at = rng.randrange(len(docs[i]))
            docs[i][at:at] = w
            hit.add(i)
    for i in range(5):  # short shared stretches are no passages
        docs[i] = docs[i][:20] + ["common%d" % j for j in range(30)] + docs[i][20:]
    docs[60] = list(docs[9])
    hit |= {9, 60} if len(docs[9]) >= 50 else set()
    return docs, hit


def test_query_finds_planted_passages_and_nothing_else(spark):
    docs, hit = corpus(15)
    rows = [(i, " ".join(w), 0) for i, w in docs.items()] + [(70, None, 0), (71, "", 0), (72, "a b", 0), (None, " ".join(docs[9]), 0)]
    out = p.repeated(spark.createDataFrame(rows, "doc_id long, text string, c int")).collect()
    assert {r.doc_id for r in out} == hit
    for r in out:
        a = docs[r.doc_id][r.start_word : r.start_word + r.n_words]
        b = docs[r.source_id][r.source_start_word : r.source_start_word + r.n_words]
        assert r.similarity >= 0.8 and len(set(a) & set(b)) >= 40


def test_repeated_ids_and_empty_table(spark):
    rng = random.Random(16)
    text = " ".join(words(rng, 80))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert {(r.doc_id, r.source_id, r.start_word, r.n_words) for r in p.repeated(docs).collect()} == {(1, 1, 0, 80), (2, 1, 0, 80)}
    assert p.repeated(docs.limit(0)).count() == 0


def test_repeat_is_found_behind_a_document_that_only_has_its_least_shingle(spark):
    rng = random.Random(31)
    t, rows, want = 46, [], set()
    for k in range(6):
        passage = words(rng, 60)
        h = p.shingles(" ".join(passage))
        # for any function and stretch: decoys hold each single shingle of the passage, and each one with what stands beside it
        decoys = [w for i in range(len(h)) for w in (*words(rng, 50), *passage[i : i + 5], *words(rng, 50))]
        again = [w for i in range(0, 31, 3) for w in (*words(rng, 50), *passage[i : i + 29], *words(rng, 50))]
        base = 10 * k
        rows += [(base, " ".join(decoys)), (base + 1, " ".join(again)), (base + 3, " ".join(again))]
        for i in (2, 4):
            rows.append((base + i, " ".join(words(rng, 70) + passage[: t + 4] + words(rng, 70))))
        want.add((base + 4, base + 2))
    out = p.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert want <= {(r.doc_id, r.source_id) for r in out}
    assert all(r.n_words >= 50 for r in out if (r.doc_id, r.source_id) in want)


def test_equal_stretches_have_equal_hashes_and_first_of_matches_brute_force():
    rng = np.random.default_rng(32)
    piece = rng.integers(0, 2**63, 50).astype(np.uint64)
    a, b = (np.concatenate([rng.integers(0, 2**63, n).astype(np.uint64), piece, rng.integers(0, 2**63, 7).astype(np.uint64)]) for n in (3, 40))
    x = p.content(p.hashed_runs(a), np.arange(len(a) - 45), np.arange(len(a) - 45) + 46)
    y = p.content(p.hashed_runs(b), np.arange(len(b) - 45), np.arange(len(b) - 45) + 46)
    assert set(x) & set(y) == set(x[3:8]) == set(y[40:45]) and len(set(x)) == len(x)
    u, v = rng.integers(0, 3, 99), rng.integers(0, 3, 99)
    assert p.first_of(u, v).tolist() == [next(i for i in range(99) if (u[i], v[i]) == (u[k], v[k])) for k in range(99)]


def test_passage_that_the_source_has_twice_or_in_part_again(spark):
    rng = random.Random(33)
    rows, want = [], set()
    for k in range(24):
        passage, filler = words(rng, 60), lambda n: words(rng, n)
        again = passage if k % 2 else passage[20:25]
        source = filler(150) + passage + filler(20 if k % 3 else 90) + again + filler(150)
        rows += [(2 * k, " ".join(source)), (2 * k + 1, " ".join(filler(200) + passage + filler(200)))]
        want.add((2 * k + 1, 2 * k, 200, 60))
    got = {(r.doc_id, r.source_id, r.start_word, r.n_words) for r in p.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got


def test_stretch_is_held_against_its_own_place():
    rng = np.random.default_rng(34)
    draw = lambda n: rng.integers(0, 2**31, n).astype(np.int32)
    x, gap = draw(56), draw(24)
    b = np.concatenate([draw(9), x, gap, x, draw(9)])
    a = np.concatenate([draw(9), x, draw(9)])
    assert list(p.agreeing(a, b, 46, 0.8)) == [(9, 65, 9, 65, 1.0)]
    assert list(p.agreeing(a, b, 46, 0.8, 80)) == [(9, 65, 89, 145, 1.0)]


def brute_pairs(docs, t=46, need=41):
    """Pairs of documents of which some t shingles in a row of each have similarity 0.8 (all of them compared)."""
    from itertools import combinations

    rows, of, number = [], [], {}
    for i, w in docs.items():
        h = [number.setdefault(tuple(w[k : k + 5]), len(number)) for k in range(len(w) - 4)]
        for k in range(len(h) - t + 1):
            rows.append(h[k : k + t])
            of.append(i)
    x = np.zeros((len(rows), len(number)), np.float32)
    for k, r in enumerate(rows):
        x[k, r] = 1
    of = np.array(of)
    near = x @ x.T >= need
    return {(a, b) for a, b in combinations(sorted(docs), 2) if near[np.ix_(of == a, of == b)].any()}


def edited(rng, w, n):
    """w with n words replaced, put in or left out, apart from each other."""
    w = list(w)
    for k in range(n):
        at = (2 * k + 1) * len(w) // (2 * n) + rng.randrange(-4, 5)
        kind = rng.randrange(3)
        w[at : at + (kind != 1)] = [] if kind == 2 else ["edit%d" % rng.randrange(10**6)]
    return w


def test_query_against_all_pairs_by_brute_force(spark):
    rng = random.Random(35)
    line = [words(rng, n) for n in (12, 30, 42)]  # too short to be passages
    docs = {i: words(rng, rng.randrange(20, 90)) for i in range(54)}
    for k in range(18):
        passage = words(rng, rng.randrange(50, 75))
        if k % 3 == 2:  # around a common line
            passage[9 : 9 + len(line[k // 3 % 3])] = line[k // 3 % 3]
            passage = passage[:66]
        for n, i in enumerate(rng.sample(range(54), 2 + k % 3)):
            w = edited(rng, passage, 1) if k % 3 == 1 and n else passage
            at = rng.randrange(len(docs[i]) + 1)
            docs[i][at:at] = w
    for i in range(0, 54, 3):
        docs[i] += line[i // 3 % 3]
    want = brute_pairs(docs)
    got = p.repeated(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()
    pairs = {(r.source_id, r.doc_id) for r in got if r.source_id != r.doc_id}
    root = {i: i for i in docs}
    for a, b in sorted(pairs):
        x, y = sorted((root[a], root[b]))
        root = {i: x if r == y else r for i, r in root.items()}
    assert len(want) > 40
    assert {i for pair in want for i in pair} == {i for pair in pairs for i in pair}
    assert all(root[a] == root[b] for a, b in want)


def test_recall_of_one_edit_in_groups_of_many_contents(spark):
    rng = random.Random(36)
    rows, groups = [], 0
    for k in range(20):
        passage = words(rng, 60)
        for n in range(12):  # more than are compared with each other
            w = passage if n < 2 else edited(rng, passage, 1)
            rows.append((100 * k + n, " ".join(words(rng, 60) + w + words(rng, 60))))
            groups += 1
    found = {r.doc_id for r in p.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) >= 0.99 * groups


def test_hot_keys_and_cut_groups_lose_nothing(spark):
    rng = random.Random(37)
    line, rows, want = words(rng, 20), [], set()
    for k in range(120):
        passage = words(rng, 20) + line + words(rng, 20)
        for i in (2 * k, 2 * k + 1):
            rows.append((i, " ".join(words(rng, 50) + passage + words(rng, 50))))
        want.add((2 * k, 2 * k + 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.source_id, r.doc_id) for r in p.repeated(docs, sample=1.0).collect()}
    assert want <= found
    w = p.windows(docs, 46, 21, 1)
    cut = p.linked(w.repartition(1), held=10).collect()
    assert {r.kind for r in cut} >= {p.NEAR, p.LEAD}
    hot = p.dealt(w, w.select("key"), share=100)
    assert hot.where("part >= 0").select("part").distinct().count() > 1


def test_shortest_run_and_other_ids(spark):
    import pytest

    assert p.shortest_run(46, 0.8) == 21 and p.shortest_run(46, 1.0) == 46
    with pytest.raises(TypeError):
        p.repeated(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_rows_of_a_group_are_joined_as_by_comparing_all_pairs():
    rng = np.random.default_rng(38)
    draw = lambda n: rng.integers(0, 2**32, n).astype(np.uint32)
    t, span, run, need, n = 46, 11, 21, 41, 240
    at, line = t - span, draw(81)
    h = np.stack([draw(81) for _ in range(n)])
    group, doc = np.repeat(np.arange(4), n // 4), rng.integers(0, n // 2, n)
    for k in range(n):
        some = np.random.default_rng(k // 12)
        a, b, own = at - some.integers(0, 12), at + span + some.integers(8, 20), some.integers(0, 2**32, 200).astype(np.uint32)
        h[k, a:b] = line[a:b]  # a common line, of less than a passage
        if k % 3:  # around it a passage that some others have too; in some a word is changed, put in or left out
            cut, gap, on = b + 3, 4 + k % 2, 100 + rng.integers(-1, 2) * (k % 4 == 1)
            h[k, a - 20 : a], h[k, b:cut] = own[:20], own[60:63]
            if k % 2:
                h[k, cut + gap :] = own[on : on + 81 - cut - gap]
            else:
                h[k, cut:] = own[95 : 95 + 81 - cut]
    before, behind = np.minimum(rng.integers(25, 60, n), at), np.minimum(rng.integers(35, 80, n), t)

    def windows(k):
        return [set(h[k, a : a + t].tolist()) for a in range(at - before[k], at + 1) if at + span <= a + t <= at + behind[k]]

    def common_run(i, j):
        lo, hi = at - min(before[i], before[j]), at + min(behind[i], behind[j])
        same = next((b - a for a, b in p.runs_of(h[i, lo:hi] == h[j, lo:hi]) if a + lo <= at and at + span <= b + lo), 0)
        return same >= run

    every = [windows(k) for k in range(n)]
    want = [(i, j) for i in range(n) for j in range(i) if group[i] == group[j] and doc[i] != doc[j] and common_run(i, j) and any(len(a & b) >= need for a in every[i] for b in every[j])]
    found = list(zip(*p.alike(group, doc, h, before, behind, t, span, run, need)))

    def trees(pairs):
        root = list(range(n))
        for a, b in pairs:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
        return root

    assert len(want) > 40 and {tuple(sorted(x, reverse=True)) for x in found} <= set(want)
    assert trees(found) == trees(want) and len(set(trees(want))) > n // 3


def test_pairs_in_a_large_group_are_found_where_leads_and_neighbours_are_unlike(spark):
    rng = random.Random(39)
    rows, want = [], set()
    for k in range(10):
        run, behind, edit = words(rng, 44), words(rng, 23), words(rng, 1)
        # texts that have a part of the first run, and nothing else of the passage
        near = [run[i : i + 29] for i in (0, 0, 0, 3, 6, 9, 12, 15, 15, 15) for _ in range(4)]
        for n, w in enumerate((*near, run + words(rng, 1) + behind, run + edit + behind)):
            rows.append((100 * k + n, " ".join(words(rng, 60) + w + words(rng, 60))))
        want.add((100 * k + 40, 100 * k + 41))
    found = {(r.source_id, r.doc_id) for r in p.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= found
