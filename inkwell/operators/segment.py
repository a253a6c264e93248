"""Documents as sections and located sentences: headings of plain text and Markdown, pages where there are none.

A document's text is cut by one regular expression inside its row, so sections need no shuffle; only the sentence splitter
leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators.structure import section_kind

#: Titles that are headings without a number or a mark.
TITLES = "Abstract|Introduction|Related Work|Background|Methods?|Methodology|Experiments?|Results|Discussion|Limitations|Conclusions?|References|Bibliography|Acknowledge?ments?|Appendix"
#: A heading line: Markdown, a number before a capital and no closing mark, or a known title.
HEADING = rf"(?:#{{1,6}}[ \t]+[^\n]{{1,120}}|\d{{1,2}}(?:\.\d{{1,2}}){{0,3}}\.?[ \t]+\p{{Lu}}[^\n.,;:!?]{{1,80}}|(?:{TITLES})[ \t]*)(?=\n|\z)"
#: Lines of a page of a text without headings; kinds of sections that are not read.
PAGE_LINES, UNREAD = 50, ("references", "acknowledgments")


def parts_of(text: Column) -> Column:
    """array of (title, level, text): what stands before the first heading is "front"; a text without headings is cut into
    pages of PAGE_LINES lines, titled "Page 1" and so on. A blank text has none."""
    cut = F.filter(F.split(text, rf"(?m)^(?={HEADING})"), lambda p: F.trim(p) != "")
    head = rf"\A({HEADING})"

    def one(p: Column) -> Column:
        line = F.regexp_extract(p, head, 1)
        title = F.trim(F.regexp_replace(line, r"^(?:#{1,6}|\d{1,2}(?:\.\d{1,2}){0,3}\.?)[ \t]+", ""))
        number = F.regexp_extract(line, r"^(\d{1,2}(?:\.\d{1,2}){0,3})\.?[ \t]", 1)
        level = F.when(line.startswith("#"), F.length(F.regexp_extract(line, "^(#+)", 1))).when(number != "", F.size(F.split(number, r"\."))).otherwise(1)
        return F.struct(F.when(line == "", "front").otherwise(title).alias("title"), level.cast("int").alias("level"), F.substr(p, F.length(line) + 1).alias("text"))

    pages = F.regexp_extract_all(text, F.lit(rf"(?:[^\n]*\n){{0,{PAGE_LINES - 1}}}[^\n]+\z|(?:[^\n]*\n){{1,{PAGE_LINES}}}"), F.lit(0))
    paged = F.transform(pages, lambda p, i: F.struct(F.concat(F.lit("Page "), (i + 1).cast("string")).alias("title"), F.lit(1).alias("level"), p.alias("text")))
    return F.when(text.rlike(rf"(?m)^{HEADING}"), F.transform(cut, one)).otherwise(paged)


def document_sections(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, section, title, kind, level, text. A subsection whose title tells no kind has that of the section above it."""
    x = docs.select(doc, F.posexplode(parts_of(F.coalesce(F.col(text), F.lit("")))).alias("section", "p")).select(doc, "section", "p.*")
    x = x.withColumn("own", section_kind(F.col("title")))
    w = Window.partitionBy(doc).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    above = F.last(F.when(F.col("level") == 1, F.col("own")), ignorenulls=True).over(w)
    kind = F.when((F.col("own") == "other") & (F.col("level") > 1), F.coalesce(above, F.lit("other"))).otherwise(F.col("own"))
    return x.select(doc, "section", "title", kind.alias("kind"), "level", "text")


def segment(sections: DataFrame, doc: str = "doc_id", unread: tuple = UNREAD) -> DataFrame:
    """doc, section_id, section_title, section_kind, id (<section>:<n>), index (in the document), text of every sentence of
    prose of the sections that are read."""
    x = sections.where(~F.col("kind").isin(*unread)).select(doc, "section", "title", "kind", F.posexplode(T.sentences("text")).alias("n", "sentence"))
    index = (F.row_number().over(Window.partitionBy(doc).orderBy("section", "n")) - 1).cast("long")
    section = F.concat(F.lit("s"), F.col("section").cast("string"))
    return x.select(doc, section.alias("section_id"), F.col("title").alias("section_title"), F.col("kind").alias("section_kind"), F.concat(section, F.lit(":"), F.col("n").cast("string")).alias("id"), index.alias("index"), F.col("sentence").alias("text"))
