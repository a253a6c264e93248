"""Ordered operators: runs, positions, carried values, windows of words and sentences, traces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_WORDS, MOST_WORDS, OVERLAP, TAIL_SHARE = 170, 260, 1, 0.25


def runs(rows: DataFrame, part: str, order: list[str], value: str) -> DataFrame:
    """rows with run: the number of the consecutive run of equal values within its part, from 1."""
    w = Window.partitionBy(part).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_change", change).withColumn("run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def relative_position(part: list[str], order: list[str]) -> Column:
    """n / (total - 1), 0 for a single row."""
    w = Window.partitionBy(*part)
    total = F.count("*").over(w)
    return F.when(total > 1, (F.row_number().over(w.orderBy(*order)) - 1) / (total - 1)).otherwise(0.0)


def carry_forward(rows: DataFrame, part: str, order: list[str], mark: str, most: int, name: str = "carried") -> DataFrame:
    """rows with name: the last non-null mark of the part's earlier rows, for up to most rows after it."""
    w = Window.partitionBy(part).orderBy(*order)
    numbered = rows.withColumn("_at", F.row_number().over(w))
    known = F.when(F.col(mark).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(mark).alias("mark")))
    last = numbered.withColumn("_last", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return last.withColumn(name, F.when(F.col("_at") - F.col("_last.at") <= most, F.col("_last.mark"))).drop("_at", "_last")


def evenly_spaced(rows: DataFrame, part: str, order: list[str], limit: int) -> DataFrame:
    """Rows floor(i * n / limit), i below limit; all rows where there are no more."""
    w = Window.partitionBy(part)
    r = rows.withColumn("_at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    # Row r is taken if some i has floor(i n / limit) = r: the smallest i with i n >= r limit must stay below r + 1.
    i = F.ceil(F.col("_at") * limit / F.col("_n"))
    return r.where((F.col("_n") <= limit) | ((i < limit) & (F.floor(i * F.col("_n") / limit) == F.col("_at")))).drop("_at", "_n")


def word_windows(tokens: Column, size: int = 120, most: int = 8) -> Column:
    """At most so many windows of size words at even strides, as arrays of words."""
    n = F.size(tokens)
    count = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(n / size).cast("int")))
    start = lambda i: F.when(count > 1, F.floor(i * (n - size) / (count - 1))).otherwise(0).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(tokens, start(i) + 1, F.lit(size)))


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true in an array."""
    step = lambda acc, f: F.struct(F.when(f, acc["now"] + 1).otherwise(0).alias("now"), F.greatest(acc["best"], F.when(f, acc["now"] + 1).otherwise(0)).alias("best"))
    return F.aggregate(flags, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), step)["best"]


def fold_parents(sections: DataFrame, part: str, order: str) -> DataFrame:
    """part, first, words: sub-sections (level > 1) add to the section before them; empty results go."""
    w = Window.partitionBy(part).orderBy(order)
    head = F.when((F.col("level") <= 1) | (F.row_number().over(w) == 1), F.col(order))
    told = sections.withColumn("first", F.last(head, ignorenulls=True).over(w))
    return told.groupBy(part, "first").agg(F.sum("words").alias("words")).where("words > 0")


def windows_of(lengths: list[int], target: int = TARGET_WORDS, most: int = MOST_WORDS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Windows [start, end) of sentences: grow to the target, never past most; a short tail joins the window before it
    if it fits; the next window starts overlap sentences back, and always further on."""
    out, start, n = [], 0, len(lengths)
    while start < n:
        end, total = start + 1, lengths[start]
        while end < n and total < target and total + lengths[end] <= most:
            total += lengths[end]
            end += 1
        tail = sum(lengths[end:])
        if 0 < tail < target * TAIL_SHARE and total + tail <= most:
            end = n
        out.append((start, end))
        if end >= n:
            break
        start = max(end - overlap, start + 1)
    return out


def chunk_sentences(sentences: DataFrame, doc: str = "doc_id", target: int = TARGET_WORDS, most: int = MOST_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """Passages of each document: (doc, chunk_index, section_id, first, last, text, token_count).

    sentences: doc, section_id, index, text. The windows depend on the data, so no frame expresses them; a document's
    sentences are one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        section, texts, index = pdf["section_id"].tolist(), pdf["text"].tolist(), pdf["index"].tolist()
        out, a = [], 0
        while a < len(texts):
            b = a
            while b < len(texts) and section[b] == section[a]:
                b += 1
            for s, e in windows_of([len(t.split()) for t in texts[a:b]], target, most, max(0, overlap)):
                text = " ".join(t.strip() for t in texts[a + s : a + e])
                out.append((pdf["doc"].iloc[0], len(out), section[a], index[a + s], index[a + e - 1], text, len(text.split())))
            a = b
        return pd.DataFrame(out, columns=["doc", "chunk_index", "section_id", "first", "last", "text", "token_count"])

    own = sentences.select(F.col(doc).cast("long").alias("doc"), F.col("section_id").cast("string").alias("section_id"), F.col("index").cast("long").alias("index"), "text")
    return own.groupBy("doc").applyInPandas(run, "doc long, chunk_index long, section_id string, first long, last long, text string, token_count long")


def fold_trace(events: DataFrame, node: list[str], at: str, kind: str, start: str, retry: str) -> DataFrame:
    """node, visits, retries, events, last_kind, first_at, last_at of a trace; the same fold runs as a stream."""
    return events.groupBy(*node).agg(
        F.sum((F.col(kind) == start).cast("long")).alias("visits"), F.sum((F.col(kind) == retry).cast("long")).alias("retries"),
        F.count("*").alias("events"), F.max_by(kind, F.struct(at, kind)).alias("last_kind"), F.min(at).alias("first_at"), F.max(at).alias("last_at"),
    )
