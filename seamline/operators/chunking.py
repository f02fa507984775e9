"""Regulation text: page clean-up, structure, paragraphs, packing, chunk rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Patterns of running heads (tested on a page's first 8 lines).
HEADS = (
    r"^\s*\d\s*편\S*\s*$",
    r"^\s*\d\s*장\S*\s*$",
    r"^\s*\d\s*편\s*\d\s*장\s*$",
    r"^\s*\d\s*편\s*부록\s*\d-\d+\s*$",
    r"^\s*부록\d-\d+\s*\S*\s*$",
    r"^\s*선급\s*및\s*강선규칙\s*(적용지침)?\s*\d{4}\s*$",
    r"^\s*\d{1,3}\s*$",
    r"^\s*-\s*[ivx]+\s*-\s*$",
)
# Line markers.
ITEM = r"^\s*(\(\d+\)|\([가-힣a-z]\)|\d{1,3}\.\s|[①-⑳]|표\s*\d|그림\s*\d|\(비고\)|제\s*\d+\s*[장절]|부록\s+\d-\d+)"
TITLE = r"^\s*\d{1,3}\.\s+\S[^.]{0,40}$"
TITLED = r"^(\s*\d{3}\.\s+\S.{0,30}?\s*\(\d{4}\))\s+(\S.{30,})$"
CHAPTER = r"^\s*제\s*(\d+)\s*장\s+(\S.{0,20}?)\s*$"
SECTION = r"^\s*제\s*(\d+)\s*절\s+(\S.{0,30}?)\s*$"
ARTICLE = r"^\s*(\d{3})\.\s+(\S.{0,40}?)(?:\s*\((\d{4})\))*\s*(?:【(?:지침|규칙)\s*참조】)?\s*$"
APPENDIX = r"^\s*부록\s+(\d-\d+)\s+(\S.+?)\s*$"
APPENDIX_ARTICLE = r"^\s*(\d{1,2})\.\s+(\S[^.]{0,38}?)(?:\s*\((\d{4})\))*\s*$"
CONTENTS = r"차   례|^\s*차 ?례\s*$"
LEADERS = r"·{4,}|…{2,}|^\s*-"
PARAGRAPH = r"^\s*\d{1,2}\.\s+(?!\d{3}\.)\S"
#: Where a long paragraph is split, level by level.
LEVELS = (r"(?=(?:^|\s)\d{1,2}\.\s)", r"(?=\(\d{1,2}\)\s)", r"(?=\([가-힣]\)\s)", r"(?=\([a-z]\)\s)", r"(?<=다\.)\s")
# Topics and their key words.
TOPICS = {
    "RT": ["방사선투과", "방사선 투과", "투과사진", "투과도계", "IQI", "필름", "농도"],
    "UT": ["초음파탐상", "초음파 탐상"],
    "MT_PT": ["자분탐상", "액체침투", "침투탐상"],
    "porosity": ["기공", "블로홀", "블로우홀"],
    "crack": ["균열", "터짐", "갈라짐"],
    "lack_of_fusion": ["융합불량", "융합 불량", "용입불량", "용입 불량"],
    "slag": ["슬래그"],
    "repair": ["보수", "재용접", "제거"],
    "acceptance": ["합격", "불합격", "허용", "판정", "등급"],
    "welding_procedure": ["용접절차", "WPS", "인정시험"],
    "welder": ["기량자격", "용접사"],
    "consumable": ["용접용재료", "용접봉", "와이어"],
}
LINES = "array<string>"


def u(pattern: str) -> str:
    """Java pattern with Unicode classes."""
    return f"(?U){pattern}"


def tokens(s: Column) -> Column:
    """Estimated tokens of a text."""
    return F.floor(F.length(s) * 0.7).cast("int")


def is_guidance(text: Column) -> Column:
    """Whether one of a page's first lines holds both marker words, spaces aside."""
    first = F.slice(F.split(text, u(r"\R")), 1, 8)
    return F.exists(first, lambda x: F.replace(x, F.lit(" "), F.lit("")).contains("적용지침") & F.replace(x, F.lit(" "), F.lit("")).contains("선급및강선규칙"))


def body_lines(text: Column, heads=HEADS) -> Column:
    """A page's lines without running heads and blank lines; a title with its body on
    one line becomes two."""
    raw = F.transform(F.split(F.coalesce(text, F.lit("")), u(r"\R")), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    head = "|".join(f"(?:{h})" for h in heads)
    kept = F.filter(raw, lambda r: ~((r["i"] < 8) & r["x"].rlike(u(head))) & (F.trim(F.regexp_replace(r["x"], u(r"\s"), " ")) != ""))
    return F.flatten(F.transform(kept, lambda r: F.when(r["x"].rlike(u(TITLED)), F.array(F.regexp_extract(r["x"], u(TITLED), 1), F.regexp_extract(r["x"], u(TITLED), 2))).otherwise(F.array(r["x"]))))


def rejoined(lines: Column) -> Column:
    """Logical lines: a line that starts no item is put to the one before, with a space
    after a sentence's end or where the line before ended in one; never to a title."""
    empty = F.array().cast(LINES)

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc)
        last = F.get(acc, n - 1)
        trimmed = F.rtrim(last)
        gap = F.when(trimmed.rlike(r"[.】):]$") | last.endswith(" "), " ").otherwise("")
        glued = F.concat(F.slice(acc, 1, n - 1), F.array(F.concat(trimmed, gap, F.ltrim(x))))
        return F.when((n == 0) | x.rlike(u(ITEM)) | last.rlike(u(TITLE)), F.concat(acc, F.array(x))).otherwise(glued)

    return F.aggregate(lines, empty, step)


def structured(pages: DataFrame, doc_type: str = "rule") -> DataFrame:
    """doc_id, doc_type, chapter, section, article, titles, page range and lines of each
    article. Lines are marked with events beside the scan; running states are
    windows over a document's lines, so a document, not the table, is one task's
    sort (it spills)."""
    at = W.partitionBy("doc_id").orderBy("page_no", "pos")
    upto = at.rowsBetween(W.unboundedPreceding, 0)
    lines = pages.select("doc_id", "page_no", is_guidance(F.col("text")).alias("guide"), F.posexplode_outer(rejoined(body_lines(F.col("text")))).alias("pos", "line"))
    lines = lines.withColumns({"pos": F.coalesce("pos", F.lit(-1)), "line": F.coalesce("line", F.lit(""))})
    line = F.col("line")
    # contents: from the marker to the first line without leaders
    marker = line.rlike(u(CONTENTS))
    plain = ~marker & ~line.rlike(u(LEADERS))
    state = F.last(F.when(marker, F.lit(True)).when(plain, F.lit(False)), ignorenulls=True).over(upto)
    # a page of contents alone may be the first guidance page: flags are taken before its lines go
    whole = W.partitionBy("doc_id")
    lines = lines.withColumns({"guided": F.max("guide").over(upto), "guide_page": F.min(F.when(F.col("guide"), F.col("page_no"))).over(whole)})
    lines = lines.withColumn("toc", F.coalesce(state, F.lit(False))).where("not toc and line <> ''")
    appendix = line.rlike(u(APPENDIX)) & ~line.contains("·")
    lines = lines.withColumns({"appendix": appendix})
    lines = lines.withColumn("in_appx", F.max("appendix").over(upto))
    first_guided = F.col("guided") & ~F.coalesce(F.lag("guided").over(at), F.lit(False))
    is_chapter = ~F.col("in_appx") & line.rlike(u(CHAPTER))
    is_section = ~F.col("in_appx") & line.rlike(u(SECTION)) & ~is_chapter
    heading = F.col("appendix") | is_chapter
    # null: no change; an empty string: cleared
    part = lambda p, i: F.regexp_extract(line, u(p), i)
    lines = lines.withColumns({
        "reset": first_guided,
        "chapter_set": F.when(F.col("appendix"), F.concat(F.lit("부록 "), part(APPENDIX, 1))).when(is_chapter, part(CHAPTER, 1)).when(first_guided, ""),
        "chapter_title_set": F.when(F.col("appendix"), part(APPENDIX, 2)).when(is_chapter, part(CHAPTER, 2)).when(first_guided, ""),
        "section_set": F.when(is_section, part(SECTION, 1)).when(heading | first_guided, ""),
        "section_title_set": F.when(is_section, part(SECTION, 2)).when(heading | first_guided, ""),
        "closes": heading | is_section,
    })
    held = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(""))
    lines = lines.withColumns({c: held(f"{c}_set") for c in ("chapter", "chapter_title", "section", "section_title")})
    short = F.col("in_appx") & line.rlike(u(APPENDIX_ARTICLE)) & ~part(APPENDIX_ARTICLE, 2).endswith("다")
    plain_article = ~F.col("in_appx") & line.rlike(u(ARTICLE))
    candidate = ~F.col("closes") & (plain_article | short)
    number = F.when(plain_article, part(ARTICLE, 1)).otherwise(part(APPENDIX_ARTICLE, 1))
    name = F.when(plain_article, part(ARTICLE, 2)).otherwise(part(APPENDIX_ARTICLE, 2))
    lines = lines.withColumns({"stop": F.sum((F.col("closes") | F.col("reset")).cast("int")).over(upto), "number": F.when(candidate, number), "name": F.when(candidate, name)})
    # a repeated heading of the article that is open stays text
    within = W.partitionBy("doc_id", "stop").orderBy("page_no", "pos")
    before = F.last("number", ignorenulls=True).over(within.rowsBetween(W.unboundedPreceding, -1))
    lines = lines.withColumn("opens", F.col("number").isNotNull() & (before.isNull() | (before != F.col("number"))))
    lines = lines.withColumn("article_no", F.sum(F.col("opens").cast("int")).over(within.rowsBetween(W.unboundedPreceding, 0)))
    # the switch to guidance closes an article on the page before
    closed = F.when(F.col("reset"), F.col("guide_page") - 1).otherwise(F.col("page_no"))
    ends = lines.where("opens or closes or reset").select("doc_id", "page_no", "pos", closed.alias("closed")).withColumn("next_page", F.lead("closed").over(at)).drop("closed")
    last_page = pages.groupBy("doc_id").agg(F.max("page_no").alias("last_page"))
    body = lines.where("article_no > 0 and not closes").groupBy("doc_id", "stop", "article_no").agg(
        F.max(F.when(F.col("guided"), "guidance").otherwise(doc_type)).alias("doc_type"),
        *(F.first(c).alias(c) for c in ("chapter", "chapter_title", "section", "section_title")),
        F.max(F.when(F.col("opens"), F.col("number"))).alias("article"),
        F.max(F.when(F.col("opens"), F.col("name"))).alias("article_title"),
        F.min(F.struct("page_no", "pos")).alias("start"),
        F.transform(F.sort_array(F.collect_list(F.when(~F.col("opens"), F.struct("page_no", "pos", "line")))), lambda x: x["line"]).alias("lines"),
    )
    ends = ends.withColumnRenamed("page_no", "p").withColumnRenamed("pos", "q").withColumnRenamed("doc_id", "d")
    out = body.join(ends, (F.col("doc_id") == F.col("d")) & (F.col("start.page_no") == F.col("p")) & (F.col("start.pos") == F.col("q")), "left").join(last_page, "doc_id")
    return out.select("doc_id", "doc_type", "chapter", "chapter_title", "section", "section_title", "article", "article_title", F.col("start.page_no").alias("page_start"), F.coalesce("next_page", "last_page").alias("page_end"), "lines")


def paragraphs(lines: Column, most: int = 700) -> Column:
    """Paragraphs from logical lines: an item line starts one; longer ones are split
    level by level, five at most (a part may stay longer after the last)."""
    empty = F.array().cast(LINES)
    step = lambda acc, x: F.when((F.size(acc) == 0) | x.rlike(u(PARAGRAPH)), F.concat(acc, F.array(F.trim(x)))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.get(acc, F.size(acc) - 1), F.trim(x)))))
    out = F.aggregate(lines, empty, step)
    for level in LEVELS:
        def refine(p: Column, pattern: str = level) -> Column:
            parts = F.filter(F.transform(F.split(p, u(pattern)), lambda x: F.trim(x)), lambda x: x != "")
            return F.when((tokens(p) > most) & (F.size(parts) > 1), parts).otherwise(F.array(p))

        out = F.flatten(F.transform(out, one(refine)))
    return out


def one(f):
    """f as a function of exactly one argument, as Spark's lambdas count them."""
    return lambda x: f(x)


def packed(paras: Column, most: int = 700, overlap: int = 1, overlap_tokens: int = 150) -> Column:
    """Groups of paragraphs: a group closes before a paragraph that would exceed `most`;
    the next begins with the last `overlap` paragraphs that are short enough."""
    groups = F.array().cast("array<array<string>>")
    start = F.struct(groups.alias("done"), F.array().cast(LINES).alias("cur"), F.lit(0).alias("n"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + tokens(x))

    def step(acc: Column, p: Column) -> Column:
        cur, n = acc["cur"], F.size(acc["cur"])
        full = (n > 0) & (acc["n"] + tokens(p) > most)
        tail = F.filter(F.slice(cur, F.greatest(n - overlap + 1, F.lit(1)), F.lit(overlap)), lambda x: tokens(x) <= overlap_tokens) if overlap else F.array().cast(LINES)
        kept = F.when(full, tail).otherwise(cur)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(cur))).otherwise(acc["done"]).alias("done"), F.concat(kept, F.array(p)).alias("cur"), (F.when(full, total(tail)).otherwise(acc["n"]) + tokens(p)).alias("n"))

    return F.aggregate(paras, start, step, lambda acc: F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))


def topics(text: Column, rules: dict[str, list[str]] = TOPICS) -> Column:
    """Names of the rules of which any key word occurs, in the rules' order."""
    tests = []
    for name, keys in rules.items():
        found = F.lit(False)
        for k in keys:
            found = found | text.contains(k)
        tests.append(F.when(found, F.lit(name)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def chunk_id(doc: Column, chapter: Column, article: Column, index: Column, body: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", doc, chapter, article, index.cast("string"), F.substring(body, 1, 64))), 1, 16)


def chunks(articles: DataFrame, meta: dict[str, str], most: int = 700, overlap: int = 1) -> DataFrame:
    """Chunk rows with id, breadcrumb, citation, topics and text."""
    g = lambda k: F.lit(meta.get(k, ""))
    some = lambda test, value: F.when(test, value).otherwise("")
    chapter, section = F.col("chapter"), F.col("section")
    appendix = chapter.startswith("부록")
    part = F.lit(meta.get("part", ""))
    crumbs = F.array(
        F.trim(F.concat_ws(" ", g("title"), g("edition"))),
        some(part != "", F.trim(F.concat(part, F.lit("편 "), g("part_title")))),
        some(chapter != "", F.trim(F.when(appendix, F.concat_ws(" ", chapter, F.col("chapter_title"))).otherwise(F.concat(chapter, F.lit("장 "), F.col("chapter_title"))))),
        some(section != "", F.trim(F.concat(section, F.lit("절 "), F.col("section_title")))),
        F.trim(F.concat(F.col("article"), F.lit(". "), F.col("article_title"))),
    )
    breadcrumb = F.array_join(F.filter(crumbs, lambda x: x != ""), " > ")
    citation = F.trim(F.regexp_replace(F.concat_ws(" ", g("short"), some(part != "", F.concat(part, F.lit("편"))), some(F.col("doc_type") == "guidance", F.lit("지침")), F.when(appendix, chapter).otherwise(F.concat(chapter, F.lit("장"))), F.concat(F.col("article"), F.lit("."))), r"\s+", " "))
    rows = articles.select("*", F.posexplode_outer(packed(paragraphs(F.col("lines"), most), most, overlap)).alias("split_index", "group")).where("group is not null")
    rows = rows.withColumns({"body": F.array_join("group", "\n"), "breadcrumb": breadcrumb, "citation": citation})
    total = F.count(F.lit(1)).over(W.partitionBy("doc_id", "doc_type", "chapter", "section", "article", "page_start"))
    return rows.select(
        chunk_id(F.col("doc_id"), chapter, F.col("article"), F.col("split_index"), F.col("body")).alias("chunk_id"), "doc_id", "doc_type", *(g(k).alias(k) for k in ("title", "publisher", "edition", "effective_date", "source_url", "license", "part")),
        "chapter", "section", "article", "article_title", "citation", "breadcrumb", "page_start", "page_end", "split_index", total.alias("split_total"), F.length("body").alias("n_chars"), tokens(F.col("body")).alias("approx_tokens"), topics(F.col("body")).alias("topics"), F.concat(F.lit("["), F.col("breadcrumb"), F.lit("]\n"), F.col("body")).alias("text"),
    )


def table_chunks(tables: DataFrame) -> DataFrame:
    """One chunk per transcribed table: tables(title, citation, page, unit, rows
    array<map>, notes); a row becomes "k: v; ..." without pipeline_class."""
    line = lambda m: F.array_join(F.transform(F.filter(F.map_entries(m), lambda e: e["key"] != "pipeline_class"), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")
    notes = F.when(F.size("notes") > 0, F.transform("notes", lambda n: F.concat(F.lit("비고: "), n))).otherwise(F.array().cast(LINES))
    body = F.array_join(F.concat(F.transform("rows", line), notes), "\n")
    return tables.withColumn("body", body).withColumn("chunk_id", F.substring(F.sha1(F.concat("citation", F.substring("body", 1, 64))), 1, 16))
