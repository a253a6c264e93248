"""Lexical and vector retrieval over long tables: one row per document and term, joins and grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: BM25 saturation and length weight; depth of each list and constant of the fusion.
K1, B, DEPTH, RRF_K = 1.5, 0.75, 100, 60


def term_counts(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """id, term, tf. Combined before the shuffle."""
    return docs.select(F.col(id_col).alias("id"), F.explode(tokens).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: list[str], id_col: str, tokens: Column, k1: float = K1, b: float = B) -> DataFrame:
    """id, score of the documents that share a term with the query; each query term counts once.

    Only the query's terms are exploded, so the shuffle is as small as their occurrences; the corpus totals are one
    aggregate."""
    told = docs.select(F.col(id_col).alias("id"), tokens.alias("tokens"))
    total = told.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avgdl"))
    wanted = F.array(*[F.lit(q) for q in dict.fromkeys(query)])
    hit = told.select("id", F.size("tokens").alias("dl"), F.explode(F.filter("tokens", lambda t: F.array_contains(wanted, t))).alias("term"))
    tf = hit.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    x = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(total))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = k1 * (1 - b + b * F.when(F.col("avgdl") > 0, F.col("dl") / F.col("avgdl")).otherwise(0.0))
    return x.groupBy("id").agg(F.sum(idf * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("score"))


def idf_table(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """term, df, idf as BM25 has it."""
    tf = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(tokens)).alias("term"))
    n = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def tfidf(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """id, term, weight: (1 + ln tf) (ln((1 + N) / (1 + df)) + 1), of unit length in each document."""
    tf = term_counts(docs, id_col, tokens)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    raw = (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    x = tf.join(df, "term").crossJoin(F.broadcast(n)).select("id", "term", raw.alias("w"))
    norm = x.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return x.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def sparse_cosine(weights: DataFrame, least: float = 0.0) -> DataFrame:
    """a, b, sim of pairs a < b that share a term, through the inverted lists, so pairs without overlap never form."""
    y = weights.select(F.col("id").alias("b"), "term", F.col("weight").alias("wb"))
    x = weights.select(F.col("id").alias("a"), "term", F.col("weight").alias("wa"))
    got = x.join(y, (x["term"] == y["term"]) & (x["a"] < y["b"])).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))
    return got.where(F.col("sim") >= least)


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def top_by(scores: DataFrame, k: int = DEPTH, score: str = "score", id_col: str = "id") -> DataFrame:
    """The k best positive scores with their rank; ties by id. A top-k per task, then of those."""
    best = scores.where(F.col(score) > 0).orderBy(F.desc(score), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), id_col)))


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """id, rrf from ranked lists (id, rank): the sum of 1 / (k + rank)."""
    out = lists[0].select("id", "rank")
    for x in lists[1:]:
        out = out.unionByName(x.select("id", "rank"))
    return out.groupBy("id").agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"))


def hybrid_search(lexical: DataFrame, dense: DataFrame, k: int = 20, depth: int = DEPTH) -> DataFrame:
    """id, bm25, dense, rrf, rank of the k best by fusion; ties by bm25, dense, id. Inputs: (id, score)."""
    a, b = top_by(lexical, depth), top_by(dense, depth)
    fused = reciprocal_rank_fusion([a, b])
    out = fused.join(a.select("id", F.col("score").alias("bm25")), "id", "left").join(b.select("id", F.col("score").alias("dense")), "id", "left")
    out = out.fillna(0.0, ["bm25", "dense"])
    order = [F.desc("rrf"), F.desc("bm25"), F.desc("dense"), F.col("id")]
    return out.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def term_coverage(docs: DataFrame, query: list[str], id_col: str, tokens: Column) -> DataFrame:
    """id, coverage: the share of the query's idf mass that a document has; unseen terms weigh as df 0."""
    told = docs.select(F.col(id_col).alias("id"), F.array_distinct(tokens).alias("tokens"))
    asked = list(dict.fromkeys(query))
    flags = [F.sum(F.array_contains("tokens", q).cast("long")) for q in asked]
    total = told.agg(F.count("*").alias("n"), *[f.alias(f"df{i}") for i, f in enumerate(flags)])
    idf = [F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) for i in range(len(asked))]
    mass = sum(idf[1:], idf[0])
    have = [F.when(F.array_contains("tokens", q), w).otherwise(0.0) for q, w in zip(asked, idf, strict=True)]
    return told.crossJoin(F.broadcast(total)).select("id", (sum(have[1:], have[0]) / mass).alias("coverage"))


#: Weights of candidate ranking with and without vectors: lexical, semantic, recency, impact.
WITH_VECTORS, WITHOUT = (0.35, 0.40, 0.15, 0.10), (0.65, 0.0, 0.20, 0.15)


def recency(age_years: Column, half_life: float = 3.0) -> Column:
    """Halves every half_life years; unknown is 0, the future 1."""
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(age_years, F.lit(0.0)) / half_life), F.lit(0.0))


def min_max(value: Column, over, flat: str = "sign") -> Column:
    """Rescaled to 0..1 over a window; a flat window gives 1 (flat="one"), or 1 where positive, else 0."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    same = F.lit(1.0) if flat == "one" else F.when(value > 0, 1.0).otherwise(0.0)
    return F.when(high > low, (value - low) / (high - low)).otherwise(same)


def min_max_all(df: DataFrame, col: str, flat: str = "sign") -> Column:
    """min_max over a whole table: its bounds are one aggregate row, collected, so no window gathers the rows."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    if low is None or not high > low:
        return F.lit(1.0) if flat == "one" else F.when(F.col(col) > 0, 1.0).otherwise(0.0)
    return (F.col(col) - low) / (high - low)


def rank_candidates(scored: DataFrame, limit: int = 20, vectors: bool = True) -> DataFrame:
    """final and rank from lexical, semantic, recency, impact in 0..1; ties by id."""
    w = WITH_VECTORS if vectors else WITHOUT
    final = sum((F.col(c) * x for c, x in zip(("semantic", "recency", "impact"), w[1:], strict=True)), F.col("lexical") * w[0])
    out = scored.withColumn("final", F.round(final, 9)).orderBy(F.desc("final"), "id").limit(limit)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final"), "id")))
