import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from seamline.llm import byte_bpe


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(17)
    words = lambda n: ["w%d" % rng.randrange(50_000) for _ in range(n)]
    clean = {i: words(80) for i in range(40)}
    item = words(30)
    docs = [(i, " ".join(w)) for i, w in clean.items()]
    docs += [(100 + i, " ".join(w)) for i, w in clean.items() if i < 5]
    for i in range(5, 15):  # near copies with one or two words changed, similarity 0.87 or 0.77 of 76 shingles
        w = list(clean[i])
        w[40] = "changed"
        if i >= 10:
            w[15] = "changed"
        docs.append((100 + i, " ".join(w)))
    docs += [(200 + i, " ".join(words(40) + item + words(40))) for i in range(4)]
    docs += [(300 + i, " ".join(w + "###" for w in words(60))) for i in range(30)]
    docs += [(400, " ".join(words(30)) + ' token = "0123456789abcdef0123456789abcdef" ' + " ".join(words(30))), (401, None), (402, "")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i < 300), 0) for i, _ in docs if i < 40 or i >= 300], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = out.columns
        out = corpus_pipeline.written(stage(spark, out, str(tmp_path)), "test")
        assert out.columns == columns
        kept.append({r.doc_id for r in out.collect()})
    good = {i for i, _ in docs if i < 300} | {400}
    assert kept[0] == good
    far = {i for i in range(110, 115)}  # below 0.8
    assert kept[1] == {i for i in good if not 100 <= i < 200} | far
    assert kept[2] == kept[3] == set(clean) | {400} | far
    text = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert "[assign]" in text[400][0] and "0123456789abcdef" not in text[400][0] and text[400][1] == len(text[400][0])
    assert all(text[i][0] == " ".join(w) for i, w in clean.items())
    final = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).collect()}
    ranks = byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks
    encoding = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert final == {i: len(encoding.encode_ordinary(t)) for i, (t, _) in text.items()}


def test_run_matches_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    out = spark.read.parquet(f"{sf}/documents.parquet")
    n = out.count()
    rows = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(rows) < n and len({r.doc_id for r in rows}) == len(rows)
