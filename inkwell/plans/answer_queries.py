"""Registered queries of question answering: routes, retrieval inside documents, re-ranking, composed answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import answering
from inkwell.session import load

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: Questions with their intents, dealt to the passages of the benchmark by number.
ASKED = [
    ("What are the main limitations of this work?", "limitations"), ("Does it fall short anywhere?", "limitations"), ("Give me an overview, please.", "summary"), ("What is the key idea here?", "summary"),
    ("How does it compare with others? Is it better than them?", "comparison"), ("What is the difference between the two?", "comparison"), ("How many points does it gain?", "results"), ("Which accuracy is reported?", "results"),
    ("How is the encoder trained?", "method"), ("Which algorithm is used?", "method"), ("Where was the study made?", "factual"), ("Who wrote the text?", "factual"),
]


@query("question_routes", "WITH a AS (SELECT item_id, [" + ", ".join(f"'{i}'" for _, i in ASKED) + f"][item_id % {len(ASKED)} + 1] AS intent FROM benchmark) SELECT item_id, intent, CASE WHEN intent IN ('summary', 'limitations') AND item_id % 5 <> 0 THEN 'compose' ELSE 'retrieve' END AS route FROM a")
def question_routes(spark, sf):
    q = F.get(F.array(*[F.lit(q) for q, _ in ASKED]), (F.col("item_id") % len(ASKED)).cast("int"))
    b = load(spark, sf, "benchmark").select("item_id", answering.intent(q).alias("intent"))
    return b.withColumn("route", answering.route(F.col("intent"), F.col("item_id") % 5 != 0))


_W = "[\\p{L}\\p{N}]+(?:[''’-][\\p{L}\\p{N}]+)*"


@query("question_passages", f"""WITH p AS (SELECT conv_id AS doc, turn AS passage, CASE WHEN turn % 4 = 3 THEN 'references' WHEN turn % 4 = 1 THEN 'method' ELSE 'other' END AS kind, list_transform(regexp_extract_all(coalesce(text, ''), '{_W}'), lambda x: lower(x)) AS t FROM conversations),
r AS (SELECT * FROM p WHERE kind <> 'references'), z AS (SELECT doc, count(*) AS n, avg(len(t)) AS avgdl FROM r GROUP BY 1), o AS (SELECT doc, passage, kind, dl, term, count(*) AS tf FROM (SELECT doc, passage, kind, len(t) AS dl, unnest(t) AS term FROM r) GROUP BY ALL),
f AS (SELECT doc, term, count(*) AS df FROM o GROUP BY ALL), q AS (SELECT DISTINCT doc, unnest(t) AS term, doc % 2 AS m FROM p WHERE passage = 0),
s AS (SELECT doc, m, passage, kind, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS bm25 FROM q JOIN o USING (doc, term) JOIN f USING (doc, term) JOIN z USING (doc) GROUP BY ALL),
g AS (SELECT *, bm25 * CASE WHEN m = 1 AND kind = 'method' THEN 1.05::DOUBLE ELSE 1 END AS score FROM s)
SELECT doc AS question_id, passage, bm25, score, row_number() OVER (PARTITION BY doc ORDER BY score DESC, bm25 DESC, passage) AS rank FROM g QUALIFY rank <= 20""")
def question_passages(spark, sf):
    """Each conversation's first turn is asked of its turns, every fourth of which counts as references."""
    c = load(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("passage"), F.coalesce("text", F.lit("")).alias("text"))
    kind = F.when(F.col("passage") % 4 == 3, "references").when(F.col("passage") % 4 == 1, "method").otherwise("other")
    q = c.where("passage = 0").select(F.col("doc_id").alias("question_id"), "doc_id", F.col("text").alias("question"), F.when(F.col("doc_id") % 2 == 1, "method").otherwise("factual").alias("intent"))
    return answering.retrieve(q, c.withColumn("kind", kind), T.terms, preferred={"method": "method"})


@query("reranked_passages", "WITH r AS (SELECT l_orderkey AS question_id, l_linenumber AS passage, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rank, CASE WHEN l_linenumber % 3 <> 0 THEN 10 * l_discount - 6 END AS logit FROM (SELECT l_orderkey, l_linenumber, min(l_discount) AS l_discount FROM lineitem GROUP BY ALL)) SELECT question_id, passage, round(1 / (1 + exp(-(logit + 3) / 2)), 9) AS relevance, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN rank <= 3 THEN coalesce(1 / (1 + exp(-(logit + 3) / 2)), 0) END DESC NULLS LAST, rank) AS place FROM r")
def reranked_passages(spark, sf):
    from pyspark.sql import Window

    x = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("passage")).agg(F.min("l_discount").alias("d"))
    c = x.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("passage"))).drop("d")
    logits = x.where("passage % 3 <> 0").select("question_id", "passage", (10 * F.col("d") - 6).alias("logit"))
    return answering.rerank(c, logits, 3).select("question_id", "passage", F.round("relevance", 9).alias("relevance"), "place")


@query("composed_answers", "WITH b AS (SELECT l_orderkey AS doc, CASE l_returnflag WHEN 'A' THEN 'problem' WHEN 'N' THEN 'method' ELSE 'limitation' END AS zone, min(l_linestatus || l_linenumber) AS text FROM lineitem GROUP BY ALL), q AS (SELECT o_orderkey AS doc, CASE o_orderkey % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'limitations' END AS intent FROM orders), w AS (SELECT doc, intent, unnest(CASE WHEN intent = 'summary' THEN ['problem', 'method', 'result'] ELSE ['limitation'] END) AS zone, unnest(CASE WHEN intent = 'summary' THEN [0, 1, 2] ELSE [0] END) AS place FROM q WHERE intent IS NOT NULL) SELECT doc AS question_id, coalesce(string_agg(text, ' ' ORDER BY place), '') AS answer, avg((text IS NOT NULL)::INT) AS confidence FROM w LEFT JOIN b USING (doc, zone) GROUP BY doc")
def composed_answers(spark, sf):
    zone = F.when(F.col("l_returnflag") == "A", "problem").when(F.col("l_returnflag") == "N", "method").otherwise("limitation")
    b = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), zone.alias("zone")).agg(F.min(F.concat("l_linestatus", F.col("l_linenumber").cast("string"))).alias("text")).withColumn("rank", F.lit(1))
    k = F.col("o_orderkey")
    q = load(spark, sf, "orders").select(k.alias("question_id"), k.alias("doc_id"), F.when(k % 3 == 0, "summary").when(k % 3 == 1, "limitations").otherwise("factual").alias("intent"))
    return answering.compose(q, b)
