"""Layout rules over lines of documents: fragments, statistics, footnotes, captions, paragraphs, titles, gates and quotes.

Lines: doc, page, line, text, x, y (from the top), width, size, bold, column. Rules that depend on neighbours are windows over
one page or one document; none needs Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import fingerprint

PAGE = ("doc", "page")
BOILERPLATE = r"(?i)^(?:arxiv|preprint|published|proceedings|copyright|https?://|doi|vol\.)"


def fragments(glyphs: DataFrame, height: float = 800.0, width: float = 600.0) -> DataFrame:
    """Glyph runs with y from the top, without blank ones and those off the page. glyphs: y from the bottom."""
    x = glyphs.withColumn("y", F.lit(height) - F.col("y"))
    return x.where((F.trim("text") != "") & F.col("y").between(0, height) & (F.col("x") < width) & (F.col("x") + F.col("width") > 0))


def body_sizes(lines: DataFrame) -> DataFrame:
    """doc, body: the size, to halves, of most characters; ties to the smaller."""
    s = lines.groupBy("doc", (F.floor(F.col("size") * 2 + 0.5) / 2).alias("s")).agg(F.sum(F.length("text")).alias("n"))
    return s.groupBy("doc").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body"))


def statistics(lines: DataFrame) -> DataFrame:
    """doc, body, pages, left, right, top, bottom, typical_width (the 80th of a hundred widths, by sorted place)."""
    w = F.array_sort(F.collect_list("width"))
    out = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"), F.min("x").alias("left"), F.max(F.col("x") + F.col("width")).alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"), w.alias("w"))
    typical = F.get("w", F.floor(0.8 * (F.size("w") - 1)).cast("int"))
    return out.withColumn("typical_width", typical).drop("w").join(body_sizes(lines), "doc")


def footnotes(lines: DataFrame, height: float = 800.0) -> DataFrame:
    """Lines below 55 % of the page, smaller than the body by half a point, with only such lines below them in their column."""
    x = lines.join(body_sizes(lines), "doc").withColumn("small", (F.col("size") <= F.col("body") - 0.5) & (F.col("y") > height * 0.55))
    below = Window.partitionBy(*PAGE, "column").orderBy(F.desc("y"), F.desc("line")).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("all_small", F.min("small").over(below)).where("all_small").select("doc", "page", "line")


def caption_blocks(lines: DataFrame, most: int = 15) -> DataFrame:
    """doc, page, line, kind, label, text of captions: an opener and the lines that go on at its size without a gap."""
    m = r"(?i)^(fig(?:ure|\.)?|table)\s*(\d+)\s*[.:|]\s*"
    w = Window.partitionBy(*PAGE, "column").orderBy("line")
    opens = F.col("text").rlike(m)
    breaks = opens | (F.col("y") - F.lag("y").over(w) > 1.8 * F.col("size")) | (F.abs(F.col("size") - F.lag("size").over(w)) > 0.5)
    x = lines.withColumn("run", F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(w)).withColumn("opens", opens)
    nth = F.row_number().over(Window.partitionBy(*PAGE, "column", "run").orderBy("line"))
    x = x.withColumn("nth", nth).where(F.col("nth") <= most)
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    g = x.groupBy(*PAGE, "column", "run").agg(F.min_by("opens", "line").alias("is"), F.min("line").alias("line"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("all"))
    kind = F.when(F.lower("all").startswith("fig"), "figure").otherwise("table")
    return g.where("is").select(*PAGE, "line", kind.alias("kind"), F.regexp_extract("all", m, 2).alias("label"), F.regexp_replace("all", m, "").alias("text"))


def learned_heading_style(lines: DataFrame) -> DataFrame:
    """doc, size, bold of most numbered heading lines, with two votes or more; ties to the larger, then the bold."""
    x = lines.where(F.col("text").rlike(r"^\d{1,2}(?:\.\d{1,2})*\.?\s+\p{Lu}") & (F.length("text") <= 90))
    n = x.groupBy("doc", "size", "bold").agg(F.count("*").alias("votes")).where("votes >= 2")
    return n.groupBy("doc").agg(F.max(F.struct("votes", "size", "bold")).alias("m")).select("doc", "m.size", "m.bold", "m.votes")


def contents_lines(lines: DataFrame) -> DataFrame:
    """Lines of a table of contents: dot leaders, or a title whose row ends by a page number."""
    return lines.where(F.col("text").rlike(r"\.{4,}|(?:\. ){3,}|^\d{0,2}(?:\.\d+)*\.?\s*\p{Lu}.*\s{2,}\d{1,3}$")).select("doc", "page", "line")


def table_residue(lines: DataFrame) -> DataFrame:
    """Cell-like lines: as many numbers as words or more, or short lines between two such."""
    words, numbers = F.regexp_count("text", F.lit(r"\p{L}{2,}")), F.regexp_count("text", F.lit(r"(?:^|\s)[+-]?\d[\d.,%]*(?=\s|$)"))
    cell = (numbers >= 1) & (numbers >= words)
    w = Window.partitionBy(*PAGE).orderBy("line")
    x = lines.withColumn("cell", cell)
    between = F.coalesce(F.lag("cell").over(w) & F.lead("cell").over(w), F.lit(False)) & (F.length("text") < 30)
    return x.withColumn("between", between).where("cell or between").select("doc", "page", "line")


def paragraphs(lines: DataFrame) -> DataFrame:
    """doc, paragraph, page, text: a gap of more than 1.55 sizes, an indent, or a new page begins a paragraph."""
    w = Window.partitionBy("doc").orderBy("page", "line")
    starts = F.coalesce((F.col("page") != F.lag("page").over(w)) | (F.col("y") - F.lag("y").over(w) > 1.55 * F.col("size")) | (F.col("x") - F.lag("x").over(w) > F.col("size")), F.lit(True))
    x = lines.withColumn("paragraph", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("page", "line", "text")))
    return x.groupBy("doc", "paragraph").agg(F.min("page").alias("page"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def titles(lines: DataFrame) -> DataFrame:
    """doc, title: the first run of lines on the first page, within 40 lines, at the largest size there, mostly letters and no
    boilerplate."""
    x = lines.where((F.col("page") == 0) & (F.col("line") <= 40) & ~F.col("text").rlike(BOILERPLATE) & (F.regexp_count("text", F.lit(r"\p{L}")) > 0.5 * F.length("text")))
    top = x.groupBy("doc").agg(F.max("size").alias("most"))
    x = x.join(top, "doc").where(F.col("size") >= F.col("most") - 0.5)
    run = F.col("line") - F.row_number().over(Window.partitionBy("doc").orderBy("line"))
    x = x.withColumn("run", run)
    first = x.groupBy("doc").agg(F.min("run").alias("run"))
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    return x.join(first, ["doc", "run"]).groupBy("doc").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("title"))


def front_abstract(paragraph: DataFrame, least: int = 400) -> DataFrame:
    """doc, abstract: the first paragraph of the first page with 400 characters or more, three quarters of them letters."""
    x = paragraph.where((F.col("page") == 0) & (F.length("text") >= least) & (F.regexp_count("text", F.lit(r"\p{L}")) > 0.75 * F.length("text")))
    return x.groupBy("doc").agg(F.min_by("text", "paragraph").alias("abstract"))


def warnings(chars_per_page: Column, pages: Column, sections: Column, references: Column, truncated: Column) -> Column:
    """What a reader should know of a parsed document, in this order."""
    told = [(truncated, "text was cut"), (chars_per_page < 80, "no text layer"), (sections == 0, "no sections"), (references == 0, "no references"), (pages >= 50, "long document")]
    return F.filter(F.array(*[F.when(c, t) for c, t in told]), lambda w: w.isNotNull())


def unusable(chars: Column, sections: Column, quality: Column) -> Column:
    """Why a document can only be read by its abstract; null where it can be read."""
    return F.when(quality == "image-only", "image-only").when(chars < 1500, "too short").when(sections == 0, "no sections")


def quoted_lines(quotes: DataFrame, lines: DataFrame, least: int = 14) -> DataFrame:
    """Lines whose letters and digits, 14 or more, are a part of a quote's. quotes: doc, quote_id, quote. Both meet by
    document."""
    q = quotes.select("doc", "quote_id", fingerprint(F.col("quote")).alias("all"))
    own = lines.select("doc", "page", "line", fingerprint(F.col("text")).alias("part")).where(F.length("part") >= least)
    return own.join(q, "doc").where(F.contains("all", "part")).select("doc", "quote_id", "page", "line")
