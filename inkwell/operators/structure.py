"""Structure of documents from positioned text: lines, reading order, furniture, headings, sections, captions, references.

Row-wise rules are expressions and windows; joining hyphenated lines and numbering headings depend on what came before
and run on one document's lines at a time.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import materialize

#: Ligatures and what they stand for. Fixed values.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
EDGE, ROW_TOLERANCE, WORD_GAP, COLUMN_GAP = 40.0, 0.3, 0.15, 2.5
KINDS = [
    ("abstract", r"^abstract"), ("introduction", r"introduction"), ("related", r"related work|literature"), ("background", r"background|preliminar"), ("limitations", r"limitation"),
    ("conclusion", r"conclu|summary"), ("references", r"^(?:references|bibliography)"), ("acknowledgments", r"acknowledg"), ("appendix", r"appendi|supplement"),
    ("discussion", r"discussion|analysis"), ("results", r"results?"), ("experiments", r"experiment|evaluation|setup"), ("method", r"method|approach|model|architecture"),
]


def clean_glyphs(c: Column) -> Column:
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(c, "[­​-‍⁠﻿]", ""), r"[  -  ]", " ")


def group_rows(glyphs: DataFrame) -> DataFrame:
    """glyphs with row: runs of a page whose baselines differ by less than 0.3 of the size are one row. glyphs: doc, page,
    text, x, y (from the top), width, size."""
    w = Window.partitionBy("doc", "page").orderBy("y", "x")
    jump = F.when(F.col("y") - F.lag("y").over(w) > ROW_TOLERANCE * F.greatest("size", F.lag("size").over(w)), 1).otherwise(0)
    return glyphs.withColumn("_jump", jump).withColumn("row", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump")


def body_size(glyphs: DataFrame) -> DataFrame:
    """doc, body: the font size, to halves, that most characters have; ties to the smaller."""
    s = glyphs.groupBy("doc", (F.floor(F.col("size") * 2 + 0.5) / 2).alias("size")).agg(F.sum(F.length("text")).alias("n"))
    return s.groupBy("doc").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body"))


def gutters(glyphs: DataFrame, width: float = 600.0) -> DataFrame:
    """doc, page, gutter: the middle of the widest empty band, of 8 units or more, in the middle 40 % of a page with 12 rows
    or more and a quarter of its runs on either side; pages without one are absent."""
    # Rows of a page are numbered from 0 without gaps; pages of few rows and bins outside the middle never count.
    low, high = int(width * 0.15), int(width * 0.35)
    rows = group_rows(glyphs).withColumn("all_rows", F.max("row").over(Window.partitionBy("doc", "page")) + 1).where("all_rows >= 12")
    start, end = F.greatest(F.floor(F.col("x") / 2).cast("int"), F.lit(low)), F.least(F.floor((F.col("x") + F.col("width")) / 2).cast("int"), F.lit(high))
    within = rows.where(F.col("x").isNotNull() & F.col("width").isNotNull()).withColumn("_a", start).withColumn("_b", end).where("_a <= _b")
    bins = within.select("doc", "page", "row", F.explode(F.sequence("_a", "_b")).alias("bin"))
    cover = bins.groupBy("doc", "page", "bin").agg(F.countDistinct("row").alias("rows"))
    total = rows.select("doc", "page", "all_rows").distinct()
    middle = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("bin")
    grid = total.select("doc", "page", "all_rows", middle).join(cover, ["doc", "page", "bin"], "left")
    empty = grid.where(F.coalesce("rows", F.lit(0)) <= 0.3 * F.col("all_rows"))
    w = Window.partitionBy("doc", "page").orderBy("bin")
    run = empty.withColumn("island", F.col("bin") - F.row_number().over(w)).groupBy("doc", "page", "island").agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    best = run.where("b - a + 1 >= 4").groupBy("doc", "page").agg(F.max_by(F.col("a") + F.col("b") + 1, F.struct(F.col("b") - F.col("a"), -F.col("a"))).alias("gutter"))
    sides = glyphs.join(best, ["doc", "page"]).groupBy("doc", "page", "gutter").agg(F.avg((F.col("x") + F.col("width") / 2 < F.col("gutter")).cast("double")).alias("left"))
    return sides.where("left between 0.25 and 0.75").select("doc", "page", F.col("gutter").cast("double").alias("gutter"))


def lines_of(glyphs: DataFrame) -> DataFrame:
    """doc, page, line, text, x, y, width, size, bold, column in reading order: runs join to cells by their gaps; a line over
    the gutter closes a band; in a band the left column comes before the right one."""
    g = group_rows(glyphs.withColumn("text", clean_glyphs(F.col("text"))).where(F.trim("text") != "")).join(gutters(glyphs), ["doc", "page"], "left")
    w = Window.partitionBy("doc", "page", "row").orderBy("x")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    over = F.col("gutter").isNotNull() & (F.lag("x").over(w) < F.col("gutter")) & (F.col("x") >= F.col("gutter"))
    g = g.withColumn("_gap", gap).withColumn("_cut", F.when((F.col("_gap") > COLUMN_GAP * F.col("size")) | over, 1).otherwise(0))
    g = g.withColumn("cell", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.concat(F.when((F.col("_cut") == 0) & (F.col("_gap") > WORD_GAP * F.col("size")), " ").otherwise(""), "text")
    g = g.withColumn("_piece", piece)
    parts = F.array_sort(F.collect_list(F.struct("x", "_piece")))
    cells = g.groupBy("doc", "page", "row", "cell", "gutter").agg(
        F.trim(F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["_piece"]), ""), r"\s+", " ")).alias("text"), F.min("x").alias("x"), F.avg("y").alias("y"),
        (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), F.max("size").alias("size"), F.max("bold").alias("bold"),
    )
    end = F.col("x") + F.col("width")
    column = F.when(F.col("gutter").isNull() | ((F.col("x") < F.col("gutter")) & (end > F.col("gutter"))), 0).when(F.col("x") < F.col("gutter"), 1).otherwise(2)
    cells = cells.withColumn("column", column)
    order = Window.partitionBy("doc", "page").orderBy("row", "x")
    cells = cells.withColumn("band", F.sum(F.when(F.col("column") == 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    line = F.row_number().over(Window.partitionBy("doc", "page").orderBy("band", "column", "y", "x"))
    return cells.select("doc", "page", line.alias("line"), "text", "x", "y", "width", "size", "bold", "column")


def furniture(lines: DataFrame, height: float = 800.0) -> DataFrame:
    """Lines at a page's edge that repeat, digits masked, on max(2, min(4, a quarter of the pages)) pages or more, and page
    numbers: doc, page, line."""
    near = lines.where((F.col("y") < EDGE) | (F.col("y") > height - EDGE))
    key = F.regexp_replace(F.lower(F.trim("text")), r"\d+", "#")
    near = near.withColumn("key", key)
    pages = lines.groupBy("doc").agg(F.least(F.lit(4), F.greatest(F.lit(2), F.floor(F.countDistinct("page") / 4 + 0.5))).alias("least"))
    often = near.groupBy("doc", "key").agg(F.countDistinct("page").alias("n")).join(pages, "doc").where("n >= least").select("doc", "key")
    number = near.where(F.trim("text").rlike(r"(?i)^(?:page\s*)?(?:\d{1,4}|[ivxl]+)$")).select("doc", "page", "line")
    return near.join(often, ["doc", "key"], "left_semi").select("doc", "page", "line").union(number).distinct()


def section_kind(title: Column) -> Column:
    out = F.when(F.lower(title).rlike(KINDS[0][1]), KINDS[0][0])
    for kind, pattern in KINDS[1:]:
        out = out.when(F.lower(title).rlike(pattern), kind)
    return out.otherwise("other")


def headings(lines: DataFrame) -> DataFrame:
    """doc, page, line, number, title, level: lines that look like headings (short, and bold, larger than the body or in
    capitals) whose numbers, if any, follow in sequence; a number may skip one."""
    body = lines.groupBy("doc", (F.floor(F.col("size") * 2 + 0.5) / 2).alias("s")).agg(F.sum(F.length("text")).alias("n")).groupBy("doc").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body"))
    number = r"^((?:\d+|[A-Z])(?:\.\d+)*)\.?\s+(\p{Lu}.*)$"
    x = lines.join(body, "doc")
    style = F.col("bold") | (F.col("size") > F.col("body") + 0.4) | (F.upper("text") == F.col("text"))
    known = F.lower("text").rlike(r"^(?:abstract|introduction|related work|background|method(?:s|ology)?|experiments?|results?|discussion|limitations|conclusions?|references|acknowledge?ments?|appendix)$")
    x = x.where(style & (F.length("text") <= 90) & ~F.col("text").rlike(r"[.,;]$|\.{4,}") & (known | F.col("text").rlike(number) | ((F.size(F.split("text", " ")) <= 8) & (F.col("size") > F.col("body") + 0.9))))
    x = x.select("doc", "page", "line", F.regexp_extract("text", number, 1).alias("number"), F.coalesce(F.nullif(F.regexp_extract("text", number, 2), F.lit("")), F.col("text")).alias("title"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page", "line"])
        last: dict[int, int] = {}
        keep, level = [], []
        for number in pdf["number"]:
            parts = [int(p) if p.isdigit() else ord(p) - 64 for p in number.split(".")] if number else []
            depth = len(parts)
            fits = not parts or 1 <= parts[-1] - last.get(depth, 0) <= 2 and all(last.get(d + 1) == p for d, p in enumerate(parts[:-1])) or (depth == 1 and number.isalpha() and parts[0] == 1)
            keep.append(fits)
            level.append(max(1, depth))
            if fits and parts:
                last = {d: v for d, v in last.items() if d < depth} | {depth: parts[-1]}
        return pdf.assign(level=level)[keep][["doc", "page", "line", "number", "title", "level"]]

    return x.groupBy("doc").applyInPandas(run, "doc long, page long, line long, number string, title string, level long")


def join_lines(lines: list[str], vocabulary: set[str]) -> str:
    """One text of lines: a word cut by a hyphen joins if the document knows the joined word, or neither of the parts with
    the hyphen; a cut link joins as it is."""
    out = ""
    for line in lines:
        m = re.search(r"([^\W\d_]+)-$", out)
        n = re.match(r"([^\W\d_]+)", line)
        if m and n:
            joined, kept = (m[1] + n[1]).lower(), (m[1] + "-" + n[1]).lower()
            out = out + line if kept in vocabulary and joined not in vocabulary else out[:-1] + line
        elif re.search(r"https?://\S*[/\-_.]$", out):
            out += line
        else:
            out = f"{out} {line}" if out else line
    return out


def sections(lines: DataFrame) -> DataFrame:
    """doc, section, title, number, kind, level, page_start, page_end, text: lines between headings, without furniture. Lines
    before the first heading are the section "front". Lines are written before they are read six times."""
    lines = materialize(lines, "lines")
    body = materialize(lines.join(furniture(lines), ["doc", "page", "line"], "left_anti"), "body")
    h = headings(body)
    marked = body.join(h, ["doc", "page", "line"], "left")
    w = Window.partitionBy("doc").orderBy("page", "line")
    marked = marked.withColumn("section", F.sum(F.when(F.col("title").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page", "line"])
        vocabulary = {w.lower() for t in pdf["text"] for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", t)[:-1]}
        rows, parts = [], {}
        for row in zip(*(pdf[c].tolist() for c in ("section", "title", "number", "level", "page", "text")), strict=True):
            parts.setdefault(row[0], []).append(row)
        for s, part in sorted(parts.items()):
            head = [r for r in part if not pd.isna(r[1])]
            told = [r[5] for r in part if pd.isna(r[1])]
            title, number, level = (head[0][1], head[0][2], int(head[0][3])) if head else ("front", "", 1)
            pages = [r[4] for r in part]
            rows.append((int(pdf["doc"].iloc[0]), int(s), title, number, level, min(pages), max(pages), join_lines(told, vocabulary)))
        return pd.DataFrame(rows, columns=["doc", "section", "title", "number", "level", "page_start", "page_end", "text"])

    out = marked.groupBy("doc").applyInPandas(run, "doc long, section long, title string, number string, level long, page_start long, page_end long, text string")
    return out.withColumn("kind", section_kind(F.col("title")))


def captions(lines: DataFrame) -> DataFrame:
    """doc, page, line, kind, label, text of lines that open a caption."""
    m = r"(?i)^(fig(?:ure|\.)|table)\s*([A-Z]?\d+)\s*[.:|]\s*(.*)$"
    kind = F.when(F.lower(F.regexp_extract("text", m, 1)).startswith("fig"), "figure").otherwise("table")
    return lines.where(F.col("text").rlike(m)).select("doc", "page", "line", kind.alias("kind"), F.regexp_extract("text", m, 2).alias("label"), F.regexp_extract("text", m, 3).alias("text"))


def reference_entries(text: DataFrame) -> DataFrame:
    """doc, position, raw of a bibliography's numbered entries ("[1] ..."). text: doc, text."""
    parts = F.filter(F.split("text", r"(?=\[\d{1,3}\]\s)"), lambda p: F.trim(p).rlike(r"^\[\d"))
    return text.select("doc", F.posexplode(F.transform(parts, F.trim)).alias("position", "raw"))


def parse_references(entries: DataFrame) -> DataFrame:
    """entries with year (the last one outside links and identifiers), arxiv, doi, title and authors."""
    raw = F.regexp_replace("raw", r"^\[\d+\]\s*", "")
    bare = F.regexp_replace(raw, r"https?://\S+|arXiv:\S+|10\.\d{4,9}/\S+", " ")
    years = F.regexp_extract_all(bare, F.lit(r"\b((?:19|20)\d{2})[a-z]?\b"), F.lit(1))
    quoted = F.regexp_extract(raw, "[“\"]([^”\"]{8,})[,.]?[”\"]", 1)
    # Sentences of the entry; a full stop after a single capital is an initial.
    pieces = F.filter(F.split(bare, r"(?<![\s.]\p{Lu}|^\p{Lu})\.\s+"), lambda p: F.length(p) > 2)
    title = F.when(quoted != "", quoted).otherwise(F.get(pieces, F.lit(1)))
    return entries.select("*", F.get(years, F.size(years) - 1).cast("int").alias("year"), F.nullif(F.regexp_extract(raw, r"(?i)arXiv[:\s]*(\d{4}\.\d{4,5})", 1), F.lit("")).alias("arxiv"), F.nullif(F.lower(F.regexp_extract(raw, r"(10\.\d{4,9}/[^\s,;]*[^\s,;.])", 1)), F.lit("")).alias("doi"), F.regexp_replace(F.trim(title), r"[,.;]+$", "").alias("title"), F.trim(F.get(pieces, F.lit(0))).alias("authors"))


def quality(pages: DataFrame) -> DataFrame:
    """doc, quality, warnings from (doc, page, chars): good, degraded or image-only by the mean characters of a page."""
    q = pages.groupBy("doc").agg(F.avg("chars").alias("mean"), F.count("*").alias("pages"))
    grade = F.when(F.col("mean") < 80, "image-only").when(F.col("mean") < 500, "degraded").otherwise("good")
    warnings = F.filter(F.array(F.when(F.col("mean") < 80, "no text layer"), F.when(F.col("pages") >= 50, "long document")), lambda w: w.isNotNull())
    return q.select("doc", grade.alias("quality"), warnings.alias("warnings"))
