"""Joins, set operations and key-value tables: containment, offsets, anti- and semi-joins, prefix scans, layered reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import url_core

#: What kept a lookup from an answer, gravest first: an outage says nothing about whether a record exists.
ERRORS = ("unreachable", "rate-limited", "server-error", "bad-response", "not-found")


def containing_chunk(sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc, index, chunk: the first chunk of the sentence's section that has its text. An equi-join on document and section
    with the containment beside it."""
    s = sentences.select("doc", "section", "index", "text")
    c = chunks.select("doc", "section", "chunk", F.col("text").alias("chunk_text"))
    return s.join(c, ["doc", "section"]).where(F.contains("chunk_text", "text")).groupBy("doc", "section", "index").agg(F.min("chunk").alias("chunk"))


def sentence_offsets(sentences: DataFrame) -> DataFrame:
    """sentences with start and end in a text that joins the sentences of their chunk by blanks. sentences: doc, chunk, index,
    text."""
    w = Window.partitionBy("doc", "chunk").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    return sentences.withColumn("start", start).withColumn("end", start + F.length("text"))


def links_outside(links: DataFrame, bibliography: DataFrame) -> DataFrame:
    """Links (doc, url) that no entry of their document's bibliography (doc, url) has, ignoring scheme and slashes."""
    own = links.withColumn("core", url_core(F.col("url")))
    cited = bibliography.select("doc", url_core(F.col("url")).alias("core")).distinct()
    return own.join(cited, ["doc", "core"], "left_anti").select("doc", "url")


def distinct_links(links: DataFrame, keys: list[str], least: int = 8) -> DataFrame:
    """The first link (by position) of each core longer than least characters."""
    x = links.withColumn("core", url_core(F.col("url"))).where(F.length("core") > least)
    first = F.row_number().over(Window.partitionBy(*keys, "core").orderBy("position"))
    return x.withColumn("nth", first).where("nth = 1").drop("nth")


def kv_scan(table: DataFrame, prefix: str) -> DataFrame:
    """Rows (key, value) whose key starts with the prefix; the comparison reaches the scan."""
    return table.where(F.col("key").startswith(prefix))


def kv_put(table: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after the changes (key, value, at): the last of a key wins, a null value deletes it."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("value"), F.col("at")).alias("v")).select("key", "v.value")
    return table.join(last, "key", "left_anti").select("key", "value").unionByName(last.where("value is not null"))


def layered(*tables: DataFrame) -> DataFrame:
    """key, value of the first table that has the key."""
    out = tables[0].select("key", "value")
    for t in tables[1:]:
        out = out.unionByName(t.select("key", "value").join(out.select("key"), "key", "left_anti"))
    return out


def gravest_error(errors: DataFrame, keys: list[str]) -> DataFrame:
    """The gravest kind of error of each key, by ERRORS; unknown kinds come last, by name."""
    rank = F.array_position(F.array(*map(F.lit, ERRORS)), F.col("kind"))
    rank = F.when(rank == 0, len(ERRORS) + 1).otherwise(rank)
    return errors.groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), "kind")).alias("x")).select(*keys, "x.kind")


def topic_search(first: DataFrame, second: DataFrame, key: str, score: Column, limit: int = 20) -> DataFrame:
    """The best of two indexes' hits (key, rank and fields of both): fields of the first win, a hit that both have comes once
    with both its ranks. A union and one grouped aggregate; the top is a bounded sort."""
    fields = [c for c in first.columns if c not in (key, "rank")]
    both = first.withColumn("src", F.lit(0)).unionByName(second.withColumn("src", F.lit(1)))
    pick = [F.min_by(c, "src", ).alias(c) for c in fields]
    ranks = [F.min(F.when(F.col("src") == i, F.col("rank"))).alias(f"rank_{i}") for i in (0, 1)]
    return both.groupBy(key).agg(*pick, *ranks).withColumn("score", score).orderBy(F.desc("score"), key).limit(limit)


def timeline(items: DataFrame, keys: list[str], time: str, label: str, every: int = 1) -> DataFrame:
    """items with place in time (ties by label), opens (a new year begins) and shown (every so many labels)."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(time, label)
    place = F.row_number().over(w) - 1
    opens = F.coalesce(F.year(time) != F.lag(F.year(time)).over(w), F.lit(True))
    return items.withColumns({"place": place, "opens": opens}).withColumn("shown", F.col("place") % every == 0)


def markdown_blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block, kind, level, text of Markdown lines (keys, n, line): runs of lines of one kind between blank lines are a
    block, a heading is one by itself, and all between fences is code. Two windows, no Python."""
    w = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*```")
    x = lines.withColumn("_fences", F.sum(fence.cast("int")).over(w))
    inside = (F.col("_fences") % 2 == 1) & ~fence
    kind = F.when(fence, "fence").when(inside, "code").when(F.trim("line") == "", "blank").when(F.col("line").rlike(r"^#{1,6}\s"), "heading").when(F.col("line").rlike(r"^\s*(?:[-*+]|\d+[.)])\s"), "list").when(F.col("line").rlike(r"^\s*\|"), "table").when(F.col("line").rlike(r"^\s*>"), "quote").otherwise("paragraph")
    x = x.withColumn("kind", kind)
    cut = (F.col("kind") == "heading") | ~F.col("kind").eqNullSafe(F.lag("kind").over(Window.partitionBy(*keys).orderBy("n")))
    x = x.withColumn("block", F.sum(cut.cast("int")).over(w)).where(~F.col("kind").isin("blank", "fence"))
    parts = F.array_sort(F.collect_list(F.struct("n", "line")))
    out = x.groupBy(*keys, "block", "kind").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("text", r"^(#+)", 1)))
    text = F.when(F.col("kind") == "heading", F.trim(F.regexp_replace("text", r"^#+", ""))).otherwise(F.col("text"))
    return out.withColumns({"level": level, "text": text}).select(*keys, "block", "kind", "level", "text")


def sparse_centroid(terms: DataFrame, group: str, item: str, term: str, weight: str) -> DataFrame:
    """group, term, weight: the sum of a group's sparse vectors over its length. Two grouped sums, no vector is collected."""
    total = terms.groupBy(group, term).agg(F.sum(weight).alias("w"))
    norm = total.groupBy(group).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("norm > 0")
    return total.join(norm, group).select(group, term, (F.col("w") / F.col("norm")).alias(weight))
