import random
from collections import Counter

from seamline.llm import decontaminate as d


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(docs, items):
    """(doc, item) pairs with any item-sized window at all of 0.8 or more."""
    out = set()
    for i, text in docs:
        w = (text or "").lower().split()
        for j, item in items:
            b = (item or "").lower().split()
            if b and w and (len(b) >= 5 or w == b):
                if any(similarity(shingles(w[s : s + len(b)]), shingles(b)) >= 0.8 for s in range(len(w))):
                    out.add((i, j))
    return out


def tables(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["v%d" % i for i in range(60)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(j, " ".join(words(rng.randrange(3, 45)))) for j in range(12)] + [(12, ""), (13, None), (14, "Solo Item")]
    docs = [(0, None), (1, ""), (2, "solo item"), (3, "x solo item y"), (4, "SOLO\tITEM")]
    for i in range(5, 90):
        w = words(rng.randrange(1, 120))
        if i % 2:
            piece = rng.choice(items[:12])[1].split()
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(piece))
                piece[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [piece[k].upper(), rng.choice(vocabulary)]])
            at = rng.randrange(len(w) + 1)
            w[at:at] = piece * rng.randrange(1, 3)
        docs.append((i, " ".join(w)))
    return docs, items, spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string"), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, h int")


def test_pairs_match_brute_force_on_either_join(spark):
    docs, items, a, b = tables(spark, 12)
    want = brute(docs, items)
    assert len(want) > 10
    for most in (1_000_000, 0):
        got = d.contaminated(a, b, broadcast_rows=most).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert len(got) == len(want)


def test_reported_window_has_the_similarity(spark):
    docs, items, a, b = tables(spark, 13)
    text, item = dict(docs), dict(items)
    for r in d.contaminated(a, b).collect():
        w = text[r.doc_id].lower().split()[r.start_word : r.start_word + r.n_words]
        assert round(similarity(shingles(w), shingles(item[r.item_id].lower().split())), 6) == r.similarity


def test_repeated_and_null_ids_and_empty_tables(spark):
    item = " ".join(f"i{k}" for k in range(20))
    a = spark.createDataFrame([(1, "z"), (1, item), (None, item + " q"), (None, None)], "doc_id long, text string")
    b = spark.createDataFrame([(5, item), (5, item), (6, item)], "item_id long, text string")
    assert sorted((str(r.doc_id), r.item_id, r.similarity) for r in d.contaminated(a, b).collect()) == [("1", 5, 1.0), ("1", 6, 1.0), ("None", 5, 1.0), ("None", 6, 1.0)]
    assert d.contaminated(a.limit(0), b).count() == 0
    assert d.contaminated(a, b.limit(0)).count() == 0


def test_leak_with_reordered_parts_is_found(spark):
    rng = random.Random(35)
    words = lambda n: ["r%d" % rng.randrange(100_000) for _ in range(n)]
    items, docs = [], []
    for k in range(6):
        parts = [words(30), words(30)] if k % 2 else [words(60), words(12), words(60)]
        items.append((k, " ".join(sum(parts, []))))
        docs.append((k, " ".join(words(40) + sum(parts[::-1], []) + words(40 if k < 4 else 0))))
    want = brute(docs, items)
    assert len(want) == 6
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = d.contaminated(a, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.start_word == 40 for r in got)
