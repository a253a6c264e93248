"""Registered aggregation and sequence queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import mining, retrieval, sequence, stats
from inkwell.session import load, materialize, spread

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _years(spark, sf):
    return load(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), "o_custkey", "o_totalprice", "o_orderpriority", "o_orderkey", "o_orderdate")


@query("year_histogram", "SELECT year(o_orderdate)::BIGINT AS value, count(*) AS n FROM orders GROUP BY 1")
def year_histogram(spark, sf):
    return stats.histogram(_years(spark, sf), F.col("y").cast("long"), 1900, 2030)


@query("year_bins", "WITH b AS (SELECT (floor(date_diff('day', DATE '1990-01-01', o_orderdate::DATE) / 500.0) * 500)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT unnest(generate_series((SELECT min(bin) FROM b), (SELECT max(bin) FROM b), 500)) AS bin) SELECT bin, coalesce(n, 0)::BIGINT AS n FROM e LEFT JOIN b USING (bin)")
def year_bins(spark, sf):
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01"))
    return stats.zero_filled(stats.histogram(_years(spark, sf), days, 0, 100000), 500)


@query("histogram_median", "WITH h AS (SELECT year(o_orderdate)::BIGINT AS v, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT v, sum(n) OVER (ORDER BY v) AS run, sum(n) OVER () AS t FROM h) SELECT min(v) AS median FROM r WHERE run * 2 >= t")
def histogram_median(spark, sf):
    return stats.histogram_median(year_histogram(spark, sf))


@query("upper_median", "SELECT o_custkey, list_sort(list(o_totalprice))[(count(*) // 2) + 1] AS median FROM orders GROUP BY 1")
def upper_median(spark, sf):
    return stats.upper_medians(_years(spark, sf), ["o_custkey"], "o_totalprice")


@query("averaged_median", "SELECT o_orderpriority, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1")
def averaged_median(spark, sf):
    return _years(spark, sf).groupBy("o_orderpriority").agg(F.round(F.median("o_totalprice"), 4).alias("median"))


@query("sorted_percentile", "SELECT o_orderpriority, list_sort(list(o_totalprice))[floor(0.3 * (count(*) - 1))::BIGINT + 1] AS percentile FROM orders GROUP BY 1")
def sorted_percentile(spark, sf):
    return stats.sorted_percentiles(_years(spark, sf), ["o_orderpriority"], "o_totalprice", 0.3)


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def latency_percentiles(spark, sf):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return load(spark, sf, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.9).alias("p90"))


@query("mean_deviation", "SELECT round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS deviation FROM lineitem")
def mean_deviation(spark, sf):
    m = stats.mean_and_deviation(load(spark, sf, "lineitem"), F.col("l_quantity"))
    return m.select(F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("first_wins", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_wins(spark, sf):
    return stats.first_wins(_years(spark, sf), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("last_wins", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def last_wins(spark, sf):
    return stats.first_wins(_years(spark, sf), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


_W = "[\\p{L}\\p{N}]+(?:[''’-][\\p{L}\\p{N}]+)*"
_WORDS = f"w AS (SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS x FROM documents)))"


def _words(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.posexplode(T.words(F.col("text"))).alias("pos", "word"))
    return d.withColumn("low", F.lower("word"))


@query("majority_form", f"WITH {_WORDS}, c AS (SELECT lower(word) AS low, word, count(*) AS n, min(doc_id * 100000 + pos) AS seen FROM w GROUP BY ALL) SELECT low, word FROM c QUALIFY row_number() OVER (PARTITION BY low ORDER BY n DESC, seen) = 1")
def majority_form(spark, sf):
    w = _words(spark, sf).withColumn("seen", F.col("doc_id") * 100000 + F.col("pos"))
    return stats.majority(w, "low", "word", "seen")


@query("proper_noun_vote", f"WITH {_WORDS} SELECT lower(word) AS low, count(*) AS uses FROM w WHERE pos > 0 GROUP BY 1 HAVING avg(CASE WHEN regexp_matches(word, '^\\p{{Lu}}') THEN 1.0 ELSE 0 END) >= 0.6")
def proper_noun_vote(spark, sf):
    share = F.avg(F.col("word").rlike(r"^\p{Lu}").cast("double"))
    return _words(spark, sf).where("pos > 0").groupBy("low").agg(F.count("*").alias("uses"), share.alias("share")).where("share >= 0.6").drop("share")


@query("zone_counts", "SELECT t.kind, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('absent'), ('search')) t(kind) LEFT JOIN (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1) USING (kind)")
def zone_counts(spark, sf):
    kinds = spark.sql("select explode(array('click', 'view', 'purchase', 'absent', 'search')) as kind")
    n = load(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return kinds.join(n, "kind", "left").fillna(0, ["n"])


@query("shared_weaknesses", "WITH v AS (SELECT l_suppkey AS voter, trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_size), '\\d+(\\.\\d+)?', '#', 'g'), '\\s+', ' ', 'g')) AS key FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT key, count(DISTINCT voter) AS voters FROM v GROUP BY key HAVING count(DISTINCT voter) >= (SELECT greatest(2, ceil(count(DISTINCT voter) / 2)) FROM v)")
def shared_weaknesses(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), T.finding_key(F.concat_ws(" ", "p_name", "p_size")).alias("key"))
    v = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("voter"), "l_partkey").distinct().join(p, "l_partkey")
    return stats.quorum(v, "key", "voter")


@query("set_jaccard", "WITH s AS (SELECT c_nationkey AS k, list(DISTINCT c_mktsegment || (c_custkey % 7)) AS s FROM customer GROUP BY 1) SELECT a.k AS a, b.k AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 9) AS jaccard FROM s a JOIN s b ON a.k < b.k")
def set_jaccard(spark, sf):
    s = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.collect_set(F.concat("c_mktsegment", (F.col("c_custkey") % 7).cast("string"))).alias("s"))
    x, y = s.select(F.col("k").alias("a"), F.col("s").alias("x")), s.select(F.col("k").alias("b"), F.col("s").alias("y"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", F.round(stats.jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))


@query("top_used", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def top_used(spark, sf):
    return stats.top_used(load(spark, sf, "part"), "p_type", 6)


@query("inverted_usage", "SELECT p_brand, count(DISTINCT p_type) AS n, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS types FROM part GROUP BY 1")
def inverted_usage(spark, sf):
    return load(spark, sf, "part").groupBy("p_brand").agg(F.countDistinct("p_type").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("p_type"))).alias("types"))


_RANKS = "r AS (SELECT custkey, row_number() OVER (PARTITION BY custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk, o_orderpriority FROM (SELECT o_custkey AS custkey, * FROM orders)), f AS (SELECT c_custkey, min(rk) FILTER (WHERE o_orderpriority LIKE '1%') AS rank FROM customer LEFT JOIN r ON c_custkey = custkey GROUP BY 1)"


@query("retrieval_metrics", f"WITH {_RANKS} SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 9) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 9) AS recall_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 9) AS recall_5, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr FROM f")
def retrieval_metrics(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    r = _years(spark, sf).withColumn("rk", F.row_number().over(w)).where("o_orderpriority like '1%'").groupBy("o_custkey").agg(F.min("rk").alias("rank"))
    f = load(spark, sf, "customer").join(r, F.col("c_custkey") == F.col("o_custkey"), "left")
    m = stats.retrieval_metrics(f)
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


_STEPS = [round(0.05 * i, 2) for i in range(1, 17)]
_ANS = "a AS (SELECT quality = 1 AS correct, (n_chars % 1000) / 1000.0 AS confidence, source FROM documents JOIN labels USING (doc_id))"


def _answers(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "source", ((F.col("n_chars") % 1000) / 1000.0).alias("confidence"))
    return d.join(load(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("correct")), "doc_id")


_T = f"t AS (SELECT unnest({_STEPS}::DOUBLE[]) AS threshold)"


@query("threshold_sweep", f"WITH {_ANS}, {_T}, s AS (SELECT threshold, sum((confidence >= threshold)::INT)::BIGINT AS answered, sum((confidence >= threshold AND correct)::INT)::BIGINT AS correct, count(*) AS n FROM a, t GROUP BY 1) SELECT threshold, answered, correct, round((correct - (answered - correct)) / n, 9) AS utility FROM s")
def threshold_sweep(spark, sf):
    return stats.threshold_sweep(_answers(spark, sf), _STEPS).withColumn("utility", F.round("utility", 9))


@query("best_threshold", f"WITH {_ANS}, {_T} SELECT threshold FROM (SELECT threshold, sum(CASE WHEN confidence >= threshold THEN CASE WHEN correct THEN 1 ELSE -1 END ELSE 0 END) AS u FROM a, t GROUP BY 1) ORDER BY u DESC, threshold LIMIT 1")
def best_threshold(spark, sf):
    return stats.best_threshold(stats.threshold_sweep(_answers(spark, sf), _STEPS)).select("threshold")


@query("leave_one_out", f"WITH {_ANS}, {_T}, g AS (SELECT source, threshold, sum(CASE WHEN confidence >= threshold THEN CASE WHEN correct THEN 1 ELSE -1 END ELSE 0 END) AS own FROM a, t GROUP BY ALL), r AS (SELECT source, threshold, (sum(own) OVER (PARTITION BY threshold) - own)::BIGINT AS rest FROM g) SELECT source, threshold, rest FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY rest DESC, threshold) = 1")
def leave_one_out(spark, sf):
    return stats.leave_one_out(_answers(spark, sf), "source", _STEPS)


@query("consecutive_runs", "WITH e AS (SELECT *, coalesce(lag(event_type) OVER w = event_type, false) AS same FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT user_id, event_type, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY 1, 2")
def consecutive_runs(spark, sf):
    r = sequence.runs(load(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")
    return r.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query("relative_position", "SELECT event_id, round(CASE WHEN count(*) OVER (PARTITION BY user_id) > 1 THEN (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / (count(*) OVER (PARTITION BY user_id) - 1) ELSE 0 END, 6) AS position FROM events")
def relative_position(spark, sf):
    return load(spark, sf, "events").select("event_id", F.round(sequence.relative_position(["user_id"], ["ts", "event_id"]), 6).alias("position"))


@query("carry_forward", "WITH n AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events), l AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN nth END) OVER (PARTITION BY user_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM n) SELECT event_id, CASE WHEN nth - was <= 5 THEN 'purchase' END AS carried FROM l")
def carry_forward(spark, sf):
    e = load(spark, sf, "events").withColumn("mark", F.when(F.col("event_type") == "purchase", "purchase"))
    return sequence.carry_forward(e, "user_id", ["ts", "event_id"], "mark", 5).select("event_id", "carried")


@query("evenly_spaced", "WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nth, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id FROM n WHERE n <= 7 OR nth IN (SELECT floor(i * n / 7) FROM range(7) t(i))")
def evenly_spaced(spark, sf):
    return sequence.evenly_spaced(load(spark, sf, "events"), "user_id", ["ts", "event_id"], 7).select("event_id")


@query("word_windows", f"WITH x AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents), c AS (SELECT doc_id, w, least(8, greatest(1, ceil(len(w) / 120)))::BIGINT AS k FROM x), i AS (SELECT doc_id, w, k, unnest(range(k)) AS i FROM c), s AS (SELECT doc_id, i, w, CASE WHEN k > 1 THEN floor(i * (len(w) - 120) / (k - 1))::BIGINT ELSE 0 END AS start FROM i) SELECT doc_id, i AS window_index, len(w[start + 1 : start + 120]) AS n, w[start + 1] AS first_word FROM s")
def word_windows(spark, sf):
    w = load(spark, sf, "documents").select("doc_id", F.posexplode(sequence.word_windows(T.words(F.col("text")))).alias("i", "w"))
    return w.select("doc_id", F.col("i").cast("long").alias("window_index"), F.size("w").cast("long").alias("n"), F.get("w", F.lit(0)).alias("first_word"))


@query("longest_run", "WITH e AS (SELECT user_id, event_type = 'click' AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events), g AS (SELECT user_id, c, nth - row_number() OVER (PARTITION BY user_id, c ORDER BY nth) AS g FROM e), r AS (SELECT user_id, count(*) AS n FROM g WHERE c GROUP BY user_id, g), u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, coalesce(max(n), 0)::BIGINT AS longest FROM u LEFT JOIN r USING (user_id) GROUP BY 1")
def longest_run(spark, sf):
    e = load(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    return e.select("user_id", sequence.longest_run(F.transform("e", lambda x: x.event_type == "click")).cast("long").alias("longest"))


@query("fold_parents", "WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS ord, CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 2 END AS level, l_quantity::BIGINT AS words FROM lineitem), h AS (SELECT *, max(CASE WHEN level <= 1 OR ord = (SELECT min(l_linenumber) FROM lineitem x WHERE x.l_orderkey = l.doc) THEN ord END) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) AS first FROM l) SELECT doc, first, sum(words)::BIGINT AS words FROM h GROUP BY 1, 2 HAVING sum(words) > 0")
def fold_parents(spark, sf):
    s = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_linenumber") % 3 == 0, 1).otherwise(2).alias("level"), F.col("l_quantity").cast("long").alias("words"))
    return sequence.fold_parents(s, "doc", "ord")


@query("trace_fold", "SELECT user_id, sum((event_type = 'view')::INT)::BIGINT AS visits, sum((event_type = 'error')::INT)::BIGINT AS retries, count(*) AS events, max_by(event_type, (ts, event_type)) AS last_kind, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def trace_fold(spark, sf):
    return sequence.fold_trace(load(spark, sf, "events"), ["user_id"], "ts", "event_type", "view", "error")


_COUNTS = f"WITH {_WORDS}, t AS (SELECT doc_id, list(lower(word) ORDER BY pos) AS t FROM w GROUP BY 1), g AS (SELECT doc_id, unnest(t) AS term FROM t UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM t), c AS (SELECT lang AS cls, term, count(*) AS n FROM g JOIN documents USING (doc_id) GROUP BY ALL)"


def _counts(spark, sf):
    d = load(spark, sf, "documents")
    return materialize(mining.grams(spread(d.select("lang", "text")), F.col("lang"), T.terms(F.col("text"))), "grams")


@query("class_tfidf", _COUNTS + ", x AS (SELECT cls, term, n, n / sum(n) OVER (PARTITION BY cls) AS share, sum(n) OVER (PARTITION BY term) AS f FROM c), m AS (SELECT avg(t) AS mean FROM (SELECT sum(n) AS t FROM c GROUP BY cls)) SELECT cls, term, round(share * ln(1 + mean / f), 9) AS weight FROM x, m QUALIFY row_number() OVER (PARTITION BY cls ORDER BY round(share * ln(1 + mean / f), 9) DESC, term) <= 8")
def class_tfidf(spark, sf):
    w = mining.class_tfidf(_counts(spark, sf)).select("cls", "term", F.round("weight", 9).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("weight"), "term"))
    return w.withColumn("rk", rank).where("rk <= 8").drop("rk")


@query("shared_terms", _COUNTS + " SELECT term, count(*) AS df, sum(n)::BIGINT AS n FROM c GROUP BY 1 HAVING count(*) >= (SELECT greatest(2, ceil(count(DISTINCT cls) / 2)) FROM c) ORDER BY count(*) * 1000 + sum(n) DESC, term LIMIT 6")
def shared_terms(spark, sf):
    return mining.shared_terms(_counts(spark, sf))


@query("bibliographic_coupling", "WITH c AS (SELECT DISTINCT c_nationkey AS doc, l_partkey AS work FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), s AS (SELECT doc, count(*) AS n FROM c GROUP BY 1), p AS (SELECT x.doc AS a, y.doc AS b, count(*) AS shared FROM c x JOIN c y ON x.work = y.work AND x.doc < y.doc GROUP BY ALL) SELECT a, b, shared, round(shared / (s.n + t.n - shared), 9) AS jaccard FROM p JOIN s ON s.doc = a JOIN s t ON t.doc = b")
def bibliographic_coupling(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey").join(load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    c = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(o, "o_orderkey")
    return mining.coupling(c.select(F.col("c_nationkey").alias("doc"), F.col("l_partkey").alias("work"))).withColumn("jaccard", F.round("jaccard", 9))


@query("direct_citations", "WITH r AS (SELECT l_suppkey AS citing, l_partkey % 500 AS key FROM lineitem), p AS (SELECT s_suppkey AS cited, unnest([s_suppkey, s_suppkey + 200]) AS key FROM supplier) SELECT DISTINCT citing, cited FROM r JOIN p USING (key) WHERE citing <> cited")
def direct_citations(spark, sf):
    r = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc"), F.array(F.col("l_partkey") % 500).alias("keys")).distinct()
    p = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc"), F.array(F.col("s_suppkey"), F.col("s_suppkey") + 200).alias("keys"))
    return mining.direct_citations(r, p)


@query("canonical_works", "WITH RECURSIVE k AS (SELECT DISTINCT o_custkey // 5 AS record, unnest([o_custkey, -(o_custkey // 20) - 1]) AS key FROM orders), e AS (SELECT DISTINCT a.key AS a, b.key AS b FROM k a JOIN k b USING (record)), c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS key, min(b) AS work FROM c GROUP BY 1")
def canonical_works(spark, sf):
    k = load(spark, sf, "orders").select("o_custkey").distinct()
    keys = F.explode(F.array(F.col("o_custkey"), F.expr("-(o_custkey div 20) - 1")))
    return mining.canonical(k.select(F.expr("o_custkey div 5").alias("record"), keys.alias("key")))


@query("theme_similarity", "WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), s AS (SELECT label, dim, sum(x) AS s FROM p GROUP BY ALL), u AS (SELECT label, dim, s / sqrt(sum(s * s) OVER (PARTITION BY label)) AS x FROM s), v AS (SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x), 7) AS sim FROM u a JOIN u b ON a.dim = b.dim AND a.label < b.label GROUP BY ALL), t AS (SELECT a % 2 AS theme, sim FROM v WHERE a % 2 = b % 2) SELECT theme::INT AS theme, round(avg(sim), 6) AS mean_sim FROM t GROUP BY 1")
def theme_similarity(spark, sf):
    c = mining.pair_similarity(mining.centroids(load(spark, sf, "embeddings"), "label", "embedding"), "label")
    t = c.where("a % 2 = b % 2").select((F.col("a") % 2).alias("theme"), F.round("sim", 7).alias("sim"))
    return t.groupBy("theme").agg(F.round(F.coalesce(F.avg("sim"), F.lit(1.0)), 6).alias("mean_sim"))


@query("closest_and_most_distinct", "WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), s AS (SELECT label, dim, sum(x) AS s FROM p GROUP BY ALL), u AS (SELECT label, dim, s / sqrt(sum(s * s) OVER (PARTITION BY label)) AS x FROM s), v AS (SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x), 6) AS sim FROM u a JOIN u b ON a.dim = b.dim AND a.label <> b.label GROUP BY ALL), m AS (SELECT a, round(avg(sim), 6) AS m FROM v GROUP BY a) SELECT (SELECT a FROM v WHERE a < b ORDER BY sim DESC, a, b LIMIT 1) AS closest_a, (SELECT b FROM v WHERE a < b ORDER BY sim DESC, a, b LIMIT 1) AS closest_b, (SELECT a FROM m ORDER BY m, a LIMIT 1) AS distinct_paper")
def closest_and_most_distinct(spark, sf):
    v = mining.pair_similarity(mining.centroids(load(spark, sf, "embeddings"), "label", "embedding"), "label").withColumn("sim", F.round("sim", 6))
    both = v.union(v.select(F.col("b"), F.col("a"), "sim"))
    lone = both.groupBy("a").agg(F.round(F.avg("sim"), 6).alias("m")).agg(F.min_by("a", F.struct("m", "a")).alias("distinct_paper"))
    near = v.agg(F.max_by(F.struct("a", "b"), F.struct("sim", -F.col("a"), -F.col("b"))).alias("p"))
    return near.crossJoin(lone).select(F.col("p.a").alias("closest_a"), F.col("p.b").alias("closest_b"), "distinct_paper")


@query("unaddressed_gaps", "WITH g AS (SELECT item_id AS gap, item_id % 3 AS paper, len(text) AS n FROM benchmark), h AS (SELECT a.gap FROM g a JOIN g b ON a.gap <> b.gap AND a.paper <> b.paper AND least(a.n, b.n) / greatest(a.n, b.n) >= 0.99) SELECT gap, paper FROM g WHERE gap NOT IN (SELECT gap FROM h)")
def unaddressed_gaps(spark, sf):
    g = load(spark, sf, "benchmark").select(F.col("item_id").alias("gap"), (F.col("item_id") % 3).alias("paper"), F.length("text").alias("n"))
    c = g.select(F.col("gap").alias("claim"), F.col("paper"))
    # Similar lengths stand for similar claims; only neighbouring lengths meet.
    b = g.select(F.col("gap").alias("claim"), F.explode(F.sequence(F.floor(F.col("n") * 0.98).cast("int"), F.ceil(F.col("n") / 0.98).cast("int"))).alias("n"), F.col("n").alias("m"))
    s = g.join(b, "n").where("gap <> claim").select("gap", "claim", (F.least("n", "m") / F.greatest("n", "m")).alias("sim"))
    return mining.unaddressed_gaps(g.select("gap", "paper"), c, s, 0.99)


@query("npmi_graph", f"WITH {_WORDS}, s AS (SELECT DISTINCT doc_id, lower(word) AS t FROM w WHERE len(word) >= 8), k AS (SELECT t FROM s GROUP BY t ORDER BY count(*) DESC, t LIMIT 18), h AS (SELECT doc_id, t FROM s JOIN k USING (t)), n AS (SELECT count(*) AS n FROM documents), c AS (SELECT t, count(*) AS c FROM h GROUP BY t), p AS (SELECT x.t AS a, y.t AS b, count(*) AS both_n FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.t < y.t GROUP BY ALL HAVING count(*) >= 2), e AS (SELECT a, b, both_n, CASE WHEN both_n >= n THEN 1 ELSE ln(both_n * n / (ca.c * cb.c)) / -ln(both_n / n) END AS npmi FROM p JOIN c ca ON ca.t = a JOIN c cb ON cb.t = b, n) SELECT a, b, both_n, round(npmi, 8) AS npmi FROM e WHERE round(npmi, 8) > 0 ORDER BY round(npmi, 8) DESC, a, b LIMIT 40")
def npmi_graph(spark, sf):
    from inkwell.operators import summarize

    s = _words(spark, sf).where(F.length("word") >= 8).select(F.col("doc_id").alias("unit"), F.col("low").alias("term")).distinct()
    top = s.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(18).select("term")
    return summarize.npmi_graph(s.join(F.broadcast(top), "term", "left_semi"), load(spark, sf, "documents").count())


@query("min_max_variants", "WITH o AS (SELECT o_orderkey, o_totalprice AS v, min(o_totalprice) OVER (PARTITION BY o_custkey) AS lo, max(o_totalprice) OVER (PARTITION BY o_custkey) AS hi FROM orders) SELECT o_orderkey, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) WHEN v > 0 THEN 1 ELSE 0 END, 9) AS by_sign, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 1 END, 9) AS by_one FROM o")
def min_max_variants(spark, sf):
    w = Window.partitionBy("o_custkey")
    return load(spark, sf, "orders").select("o_orderkey", F.round(retrieval.min_max(F.col("o_totalprice"), w), 9).alias("by_sign"), F.round(retrieval.min_max(F.col("o_totalprice"), w, "one"), 9).alias("by_one"))


@query("recency_impact", "SELECT o_orderkey, round(pow(0.5, greatest((epoch(TIMESTAMP '1999-01-01') - epoch(o_orderdate)) / 31557600.0, 0) / 3), 9) AS recency, round(ln(1 + o_totalprice) / max(ln(1 + o_totalprice)) OVER (PARTITION BY o_orderpriority), 9) AS impact FROM orders")
def recency_impact(spark, sf):
    age = (F.lit(915148800) - F.unix_timestamp("o_orderdate")) / 31557600.0
    impact = F.log1p("o_totalprice") / F.max(F.log1p("o_totalprice")).over(Window.partitionBy("o_orderpriority"))
    return load(spark, sf, "orders").select("o_orderkey", F.round(retrieval.recency(age), 9).alias("recency"), F.round(impact, 9).alias("impact"))
