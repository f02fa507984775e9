from pyspark.sql import functions as F

from seamline.operators import chunking as C
from seamline.operators import dataset as D


def test_page_lines(spark):
    page = "제2편\n 12 \n제 1 장 총칙\n101. 적용 (2021) 이 규정은 선체의 용접 이음부 전체에 대하여 빠짐없이 적용한다고 본다.\n이어지는 줄\n\n1. 첫째\n계속한다.\n다음 줄"
    df = spark.createDataFrame([(page,)], "text string")
    lines = df.select(C.body_lines(F.col("text")).alias("x")).first().x
    assert " 12 " not in lines and "101. 적용 (2021)" in lines and "" not in lines
    joined = spark.createDataFrame([(["101. 적용", "본문이", "이어진다.", "또 한 줄", "(1) 항목"],)], "x array<string>").select(C.rejoined(F.col("x")).alias("y")).first().y
    assert joined == ["101. 적용", "본문이이어진다. 또 한 줄", "(1) 항목"]


def test_structure_follows_the_state_machine(spark):
    one = "차례\n제 1 장 목차 ····· 1\n제 1 장 총칙\n앞글 없음.\n101. 적용\n1. 본문이다.\n제 2 절 검사\n102. 방법\n(1) 항목이다.\n101. 다시\n본문."
    two = "부록 2-7 비파괴검사\n1. 적용\n가나다라.\n제 3 장 무시\n2. 요건\n본문이다."
    rows = C.structured(spark.createDataFrame([("a", 1, one), ("a", 2, two)], "doc_id string, page_no int, text string")).orderBy("page_start", "article").collect()
    got = [(r.chapter, r.section, r.article, r.page_start) for r in rows]
    assert got == [("1", "", "101", 1), ("1", "2", "101", 1), ("1", "2", "102", 1), ("부록 2-7", "", "1", 2), ("부록 2-7", "", "2", 2)]
    assert rows[0].lines == ["1. 본문이다."] and rows[0].page_end == 1 and rows[-1].page_end == 2


def test_packing_keeps_every_paragraph_and_overlaps_short_ones(spark):
    size = lambda n: "x" * round(n / 0.7 + 0.5)
    paras = [size(300), size(300), size(300), size(100), size(700)]
    got = spark.createDataFrame([(paras,)], "p array<string>").select(C.packed(F.col("p")).alias("g")).first().g
    assert [[round(len(x) * 0.7) // 100 * 100 for x in g] for g in got] == [[300, 300], [300, 100], [100, 700]]
    empty = spark.createDataFrame([([],)], "p array<string>").select(C.packed(F.col("p")).alias("g")).first().g
    assert empty == []


def test_label_lines_and_unmatched_files(spark):
    lines = ["0 0.1 0.1 0.2 0.1 0.2 0.2", "0 0.1 0.1", "0 0.1 0.1 0.2 0.1 0.2", "0 0.1 0.1 0.2 0.1 0.2 1.5", "0 a 0.1 0.2 0.1 0.2 0.2"]
    got = [r.f for r in spark.createDataFrame([(x,) for x in lines], "line string").select(D.line_faults(F.col("line")).alias("f")).collect()]
    assert got == [None, "grammar", "grammar", "range", "grammar"]
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r.k, r.side) for r in D.unmatched(a, b, "k").collect()} == {(1, "no label"), (3, "no image")}
