"""File sources and sinks: binary documents, HTML text, Markdown and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document of more bytes is listed with the status "too large" and not read.
MOST_BYTES = 50 << 20


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, status, is_pdf, is_html, upload_id of every file; PDF by its signature in the first KB. A file beyond
    MOST_BYTES has a row with the status "too large" and nulls; the rest are "ok". Spark's reader lists no empty files."""
    files = spark.read.format("binaryFile").load(path)
    status = F.when(F.col("length") > MOST_BYTES, "too large").otherwise("ok")
    files = files.withColumn("status", status).withColumn("content", F.when(F.col("status") != "too large", F.col("content")))
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    html = F.lower(F.ltrim(head)).rlike("^(<!doctype html|<html|<head|<body)")
    return files.select("path", F.col("length").alias("bytes"), "status", head.contains("%PDF-").alias("is_pdf"), html.alias("is_html"), F.substring(F.sha2("content", 256), 1, 12).alias("upload_id"))


def html_text(c: Column) -> Column:
    """Visible text: scripts, styles and comments out, tags to blanks, the common entities decoded."""
    c = F.regexp_replace(c, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def title_of_file(c: Column) -> Column:
    """A title from a file's name: no path, query or extension, separators to blanks."""
    name = F.regexp_extract(F.regexp_replace(c, r"[?#].*$", ""), r"([^/\\]*)$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""), r"[_\s-]+", " "))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(briefings: DataFrame) -> DataFrame:
    """doc_id, value: a Markdown brief from title, summary, findings (severity, title), numbers (value, label), axes
    (label, score) and overall; each part is left out where it is empty."""
    part = lambda head, c, row: F.when(F.size(c) > 0, F.concat(F.lit(f"\n## {head}\n\n"), F.array_join(F.transform(c, row), "\n"), F.lit("\n"))).otherwise("")
    text = F.concat(
        F.lit("# "), F.coalesce("title", F.lit("Untitled")), F.lit("\n"), part("Summary", F.col("summary"), lambda s: F.concat(F.lit("- "), s)),
        part("Review", F.col("findings"), lambda f: F.concat(F.lit("- **"), f["severity"], F.lit("** "), f["title"])),
        part("Key numbers", F.col("numbers"), lambda n: F.concat(F.lit("| "), n["value"], F.lit(" | "), n["label"], F.lit(" |"))),
        part("Rigor", F.col("axes"), lambda a: F.concat(F.lit("- "), a["label"], F.lit(": "), a["score"].cast("string"), F.lit("/100"))),
    )
    return briefings.select("doc_id", text.alias("value"))


def write_markdown(df: DataFrame, path: str) -> None:
    """One text file per partition; a document's brief is one row."""
    df.select("value").write.mode("overwrite").text(path)
