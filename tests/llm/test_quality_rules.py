import random
import re
from collections import Counter

from seamline.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics_match_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\x0b", "one", "a b c d e f g h", "a b c d e f g h " * 3, "x\n\nx\n x\nx", "é#|\U0001f642 <b>\x85 \x1cq"]
    for _ in range(150):
        unit = [rng.choice(["a", "b", "cé", "#$", "\n", "d\n"]) for _ in range(rng.randrange(1, 80))]
        texts.append(rng.choice([" ", "\t", "  "]).join(unit * rng.randrange(1, 4)))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words long")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.text_statistics(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def corpus(spark, n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        words = ["w%d" % rng.randrange(5000) for _ in range(rng.randrange(40, 90))]
        if bad and rng.random() < 0.5:
            words = [w + "###" for w in words]
        elif bad:
            words = words[:6] + ["and"] * 12 + words[20:]
            words += [w + "|" for w in words[:30]]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learned_list_on_held_out_rows(spark):
    docs, labels = corpus(spark, 600, 7)
    stats = q.text_statistics(docs)
    rules = q.learn(stats, labels)
    assert rules and all(1 <= len(r) <= 4 for r in rules)
    new, truth = corpus(spark, 300, 8)
    rows = q.judged(q.text_statistics(new), rules).join(truth, "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) for r in rows)
    assert right >= 0.95 * len(rows)
    assert sum(not r.kept for r in rows if r.quality == 1) <= 0.02 * len(rows)


def test_no_labels_odd_labels_and_empty_tables(spark):
    docs, labels = corpus(spark, 30, 9)
    assert q.quality(docs, labels.limit(0)).where("not kept and not base_failed").count() == 0
    odd = spark.createDataFrame([(1, None, 0), (None, 0, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert q.quality(docs, odd).count() == 30
    assert q.quality(docs.limit(0), labels).count() == 0
