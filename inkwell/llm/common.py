"""Shared parts of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.session import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def attach(rows: DataFrame, table: DataFrame, key: str, share: int = 512) -> DataFrame:
    """rows joined with the one row that table has of each key; rows without one go.

    Keys with more than a share-th of all rows, fewer than share of them by that definition, are joined by broadcasting
    their rows of table, so that no key's rows meet in one task; the rest are joined by shuffle. rows is read three times:
    it should be a written table.
    """
    total = rows.count()
    often = rows.groupBy(key).count().where(F.col("count") > max(total / share, 256)).select(key)
    hot = [r[0] for r in often.collect()]
    if not hot:
        return rows.join(table, key)
    few = rows.sparkSession.createDataFrame([(k,) for k in hot], rows.select(key).schema)
    own = rows.join(F.broadcast(table.join(F.broadcast(few), key, "left_semi")), key)
    return own.unionByName(rows.join(F.broadcast(few), key, "left_anti").join(table, key))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (id, component) per node that has an edge,
    component being the smallest id reachable.

    Alternates large-star and small-star steps until the edges are stars around each smallest node; every step is
    a grouped minimum (combined before the shuffle) and a join that gives hot hubs by broadcast, so no node's neighbours
    meet in one task. Each round is written to the shared folder and the one before deleted. Self-loops and repeated
    edges are allowed; an empty input gives an empty result.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    own = Scratch(scratch.spark)
    e = own.keep(both.where("u <> v").distinct(), "e0")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    now, was, k = mark(e), None, 0
    while now != was and now[0]:
        k += 1
        n = e.select("u", "v").union(e.select("v", "u"))
        m = n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = attach(n.where("v > u"), m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = own.keep(large.where("u <> v").distinct(), f"l{k}")
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = attach(large, m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = own.keep(small.union(m.select("u", "m")).distinct(), f"e{k}")
        was, now = now, mark(e)
        own.drop(f"l{k}", f"e{k - 1}")
    roots = e.select(F.col("v").alias("id")).distinct()
    out = scratch.keep(e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", "id")), "components")
    own.drop()
    return out
