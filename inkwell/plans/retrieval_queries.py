"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import mining, retrieval
from inkwell.session import load

QUERY = ["the", "tion", "erst", "thing", "and", "der", "the"]
QUERIES, SQL = {}, {}
_W = "[\\p{L}\\p{N}]+(?:[''’-][\\p{L}\\p{N}]+)*"
_DOCS = f"d AS (SELECT doc_id AS id, list_transform(regexp_extract_all(coalesce(text, ''), '{_W}'), lambda x: lower(x)) AS tokens FROM documents)"
_ASKED = "(" + ", ".join(f"'{q}'" for q in dict.fromkeys(QUERY)) + ")"
_BM25 = f"""
{_DOCS}, tot AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM d) WHERE term IN {_ASKED} GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
lex AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
        FROM tf JOIN df USING (term), tot GROUP BY id)
"""


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _docs(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "text")


def _lex(spark, sf):
    return retrieval.bm25(_docs(spark, sf), QUERY, "doc_id", T.terms(F.col("text")))


@query("bm25_top20", f"WITH {_BM25} SELECT id AS doc_id, round(score, 6) AS score FROM lex ORDER BY round(score, 6) DESC, id LIMIT 20")
def bm25_top20(spark, sf):
    s = _lex(spark, sf).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))
    return s.orderBy(F.desc("score"), "doc_id").limit(20)


@query("idf_table", f"WITH {_DOCS} SELECT term, df, round(ln(1 + ((SELECT count(*) FROM d) - df + 0.5) / (df + 0.5)), 9) AS idf FROM (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM d) GROUP BY term)")
def idf_table(spark, sf):
    return retrieval.idf_table(_docs(spark, sf), "doc_id", T.terms(F.col("text"))).withColumn("idf", F.round("idf", 9))


_TFIDF = """tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM d),
w AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n),
u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w)"""


@query("tfidf_terms", f"WITH {_DOCS}, {_TFIDF} SELECT id AS doc_id, term, round(weight, 8) AS weight FROM u")
def tfidf_terms(spark, sf):
    w = retrieval.tfidf(_docs(spark, sf), "doc_id", T.terms(F.col("text")))
    return w.select(F.col("id").alias("doc_id"), "term", F.round("weight", 8).alias("weight"))


_BENCH = _DOCS.replace("doc_id AS id", "item_id AS id").replace("FROM documents", "FROM benchmark")


@query("sparse_cosine_pairs", f"WITH {_BENCH}, {_TFIDF} SELECT x.id AS a, y.id AS b, round(sum(x.weight * y.weight), 7) AS sim FROM u x JOIN u y ON x.term = y.term AND x.id < y.id GROUP BY ALL HAVING sum(x.weight * y.weight) >= 0.05")
def sparse_cosine_pairs(spark, sf):
    w = retrieval.tfidf(load(spark, sf, "benchmark"), "item_id", T.terms(F.col("text")))
    return retrieval.sparse_cosine(w, 0.05).withColumn("sim", F.round("sim", 7))


def _dense(spark, sf):
    v = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    # One row, found by its key.
    q = v.where("id = 0").select(F.col("embedding").alias("q"))
    return v.crossJoin(F.broadcast(q)).select("id", retrieval.cosine(F.col("embedding"), F.col("q")).alias("score"))


_DENSE = """q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
den AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))) AS score FROM embeddings, q)"""


@query("dense_cosine_top20", f"WITH {_DENSE} SELECT id AS vec_id, round(score, 6) AS score FROM den WHERE score > 0 ORDER BY round(score, 6) DESC, id LIMIT 20")
def dense_cosine_top20(spark, sf):
    s = _dense(spark, sf).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))
    return s.where("score > 0").orderBy(F.desc("score"), "vec_id").limit(20)


_RANKED = """a AS (SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM lex WHERE round(score, 6) > 0 QUALIFY rank <= 100),
b AS (SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM den WHERE round(score, 6) > 0 QUALIFY rank <= 100)"""


@query("hybrid_search", f"""WITH {_BM25}, {_DENSE}, {_RANKED},
f AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.score, 0) AS bm25, coalesce(b.score, 0) AS dense, coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0) AS rrf FROM a FULL JOIN b ON a.id = b.id)
SELECT id, bm25, dense, round(rrf, 9) AS rrf, row_number() OVER (ORDER BY round(rrf, 9) DESC, bm25 DESC, dense DESC, id) AS rank FROM f QUALIFY rank <= 20""")
def hybrid_search(spark, sf):
    r = lambda s: s.withColumn("score", F.round("score", 6))
    out = retrieval.hybrid_search(r(_lex(spark, sf)), r(_dense(spark, sf)))
    return out.select("id", "bm25", "dense", F.round("rrf", 9).alias("rrf"), "rank")


@query("rrf_union", f"WITH {_BM25}, {_DENSE}, {_RANKED} SELECT id, round(sum(1 / (60 + rank)), 9) AS rrf FROM (SELECT id, rank FROM a UNION ALL SELECT id, rank FROM b) GROUP BY id")
def rrf_union(spark, sf):
    r = lambda s: retrieval.top_by(s.withColumn("score", F.round("score", 6)))
    return retrieval.reciprocal_rank_fusion([r(_lex(spark, sf)), r(_dense(spark, sf))]).withColumn("rrf", F.round("rrf", 9))


@query("term_coverage", f"""WITH {_DOCS}, q AS (SELECT unnest(['the', 'tion', 'erst', 'thing', 'and', 'der']) AS term), n AS (SELECT count(*) AS n FROM d),
w AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(id) AS df FROM q LEFT JOIN d ON list_contains(tokens, term) GROUP BY term), n)
SELECT id AS doc_id, round(sum(CASE WHEN list_contains(tokens, term) THEN idf ELSE 0 END) / sum(idf), 9) AS coverage FROM d, w GROUP BY id""")
def term_coverage(spark, sf):
    s = retrieval.term_coverage(_docs(spark, sf), QUERY, "doc_id", T.terms(F.col("text")))
    return s.select(F.col("id").alias("doc_id"), F.round("coverage", 9).alias("coverage"))


@query("rank_candidates", f"""WITH {_BM25}, o AS (SELECT o_orderkey AS id, greatest((epoch(TIMESTAMP '1999-01-01') - epoch(o_orderdate)) / 31557600.0, 0) AS age, o_totalprice FROM orders),
x AS (SELECT id, CASE WHEN (SELECT max(score) > min(score) FROM lex JOIN o USING (id)) THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END AS lexical,
pow(0.5, age / 3) AS recency, ln(1 + o_totalprice) / max(ln(1 + o_totalprice)) OVER () AS impact FROM lex JOIN o USING (id)),
y AS (SELECT id, round(lexical, 6) AS lexical, round(recency, 6) AS recency, round(impact, 6) AS impact FROM x),
z AS (SELECT *, round(lexical * 0.65 + 0 + recency * 0.20 + impact * 0.15, 9) AS final FROM y)
SELECT id, lexical, recency, impact, final, row_number() OVER (ORDER BY final DESC, id) AS rank FROM z QUALIFY rank <= 20""")
def rank_candidates(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), ((F.lit(915148800) - F.unix_timestamp("o_orderdate")) / 31557600.0).alias("age"), F.log1p("o_totalprice").alias("cited"))
    x = _lex(spark, sf).join(o, "id")
    impact = F.col("cited") / F.lit(x.agg(F.max("cited")).first()[0])
    x = x.select("id", F.round(retrieval.min_max_all(x, "score"), 6).alias("lexical"), F.lit(0.0).alias("semantic"), F.round(retrieval.recency(F.col("age")), 6).alias("recency"), F.round(impact, 6).alias("impact"))
    return retrieval.rank_candidates(x, vectors=False).drop("semantic")


@query("centroids", """WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), s AS (SELECT label, dim, sum(x) AS s FROM p GROUP BY ALL)
SELECT label, dim, round(s / sqrt(sum(s * s) OVER (PARTITION BY label)), 6) AS x FROM s""")
def centroids(spark, sf):
    return mining.centroids(load(spark, sf, "embeddings"), "label", "embedding").withColumn("x", F.round("x", 6))


@query("mean_centred_similarity", """WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), s AS (SELECT label, dim, sum(x) AS s FROM p GROUP BY ALL),
u AS (SELECT label, dim, s / sqrt(sum(s * s) OVER (PARTITION BY label)) AS x FROM s), c AS (SELECT label, dim, x - avg(x) OVER (PARTITION BY dim) AS x FROM u),
v AS (SELECT label, dim, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM c)
SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x), 6) AS sim FROM v a JOIN v b ON a.dim = b.dim AND a.label < b.label GROUP BY ALL""")
def mean_centred_similarity(spark, sf):
    c = mining.centroids(load(spark, sf, "embeddings"), "label", "embedding")
    return mining.pair_similarity(mining.mean_centred(c, "label"), "label").withColumn("sim", F.round("sim", 6))


@query("silhouette", """WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.id, a.label, b.label AS other, count(*) AS n, sum(1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))) AS s FROM e a JOIN e b ON a.id <> b.id GROUP BY ALL),
m AS (SELECT id, max(CASE WHEN label = other THEN s / n END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b FROM p GROUP BY id)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m""")
def silhouette(spark, sf):
    return mining.silhouette(load(spark, sf, "embeddings"), "vec_id", "label", "embedding").select(F.round("silhouette", 6).alias("silhouette"))
