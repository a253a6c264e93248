"""Registered queries of scalar rules, lookups, set operations and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import scalars as S
from inkwell.operators import lookups
from inkwell.session import load

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_TURNS = "t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)"


def _turns(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


@query("ranking_scalars", "SELECT event_id, round(least(1, greatest(0, (value / 500 - 0.15) / 0.6)), 9) AS rescaled, round(1 / (1 + exp(-(value / 100 + 3) / 2)), 9) AS relevance, round(1 - exp(-value / 300), 9) AS squashed, greatest(1, floor(value / 200 + 0.5)::BIGINT) AS minutes FROM events")
def ranking_scalars(spark, sf):
    v = F.col("value")
    return load(spark, sf, "events").select("event_id", F.round(S.rescale(v / 500, 0.15, 0.75), 9).alias("rescaled"), F.round(S.relevance(v / 100), 9).alias("relevance"), F.round(S.squash(v / 300), 9).alias("squashed"), S.reading_minutes(v).alias("minutes"))


@query("softmax_shares", "WITH e AS (SELECT l_orderkey, l_linenumber, exp((l_discount - m) / 0.09) AS a, exp((l_tax - m) / 0.09) AS b, exp((0.05 - m) / 0.09) AS c FROM (SELECT *, greatest(l_discount, l_tax, 0.05) AS m FROM lineitem)) SELECT l_orderkey, l_linenumber, round(a / (a + b + c), 9) AS discount, round(b / (a + b + c), 9) AS tax FROM e")
def softmax_shares(spark, sf):
    d, t, _ = S.softmax([F.col("l_discount"), F.col("l_tax"), F.lit(0.05)], 0.09)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(d, 9).alias("discount"), F.round(t, 9).alias("tax"))


@query("publication_times", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE + 14 WHEN 2 THEN make_date(year(o_orderdate), 7, 1) END AS published, CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE round(pow(0.5, greatest(0, date_diff('day', CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE + 14 ELSE make_date(year(o_orderdate), 7, 1) END, DATE '1997-01-01')) / 365.25 / 3), 9) END AS recency FROM orders")
def publication_times(spark, sf):
    form = F.col("o_orderkey") % 4
    told = F.when(form == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(form == 1, F.date_format("o_orderdate", "yyyy-MM")).when(form == 2, F.date_format("o_orderdate", "yyyy")).otherwise("in press")
    p = S.publication_time(told)
    return load(spark, sf, "orders").select("o_orderkey", p.alias("published"), F.round(S.recency(p, F.lit("1997-01-01").cast("date")), 9).alias("recency"))


@query("parsed_values", "WITH v AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice / 100, 1) AS v, CASE l_linenumber % 3 WHEN 0 THEN '%' WHEN 1 THEN 'ms' ELSE '' END AS unit FROM lineitem) SELECT l_orderkey, l_linenumber, v AS magnitude, unit, round(v / max(v) OVER (PARTITION BY unit), 9) AS fraction FROM v")
def parsed_values(spark, sf):
    unit = F.when(F.col("l_linenumber") % 3 == 0, "%").when(F.col("l_linenumber") % 3 == 1, " ms").otherwise("")
    shown = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-"), F.format_number(F.round(F.col("l_extendedprice") / 100, 1), 1), unit)
    x = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.parse_value(shown).alias("p")).select("l_orderkey", "l_linenumber", "p.*")
    # The largest of a unit by a grouped maximum, so that no unit's rows meet in one task.
    top = x.groupBy("unit").agg(F.max("magnitude").alias("top"))
    return x.join(F.broadcast(top), "unit").select("l_orderkey", "l_linenumber", "magnitude", "unit", F.round(F.col("magnitude") / F.col("top"), 9).alias("fraction"))


@query("fnv_ids", "SELECT c_custkey, lower(to_base(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(c_name, ''), lambda x: ord(x)::UBIGINT)), lambda h, b: ((xor(h, b) * 16777619) % 4294967296)::UBIGINT)::BIGINT, 36)) AS id FROM customer")
def fnv_ids(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", S.fnv1a(F.col("c_name")).alias("id"))


@query("identity_keys", "WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM part) SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'arxiv:2001.' || p_partkey END, CASE WHEN p_partkey % 3 = 0 THEN 'doi:10.1/x' || p_partkey END, CASE WHEN len(string_split(t, ' ')) >= 3 AND len(replace(t, ' ', '')) >= 15 THEN 'title:' || t END], lambda x: x IS NOT NULL), '|') AS keys FROM p")
def identity_keys(spark, sf):
    k = F.col("p_partkey")
    arx, doi = F.when(k % 2 == 0, F.concat(F.lit("2001."), k, F.lit("v"), k % 5 + 1)), F.when(k % 3 == 0, F.concat(F.lit("10.1/X"), k))
    return load(spark, sf, "part").select("p_partkey", F.array_join(S.identity_keys(arx, doi, F.concat_ws(" ", "p_name", "p_type")), "|").alias("keys"))


@query("dataset_keys", "SELECT p_partkey, regexp_replace(lower(p_brand || '-' || p_type), '[^\\p{L}\\p{N}]+', '', 'g') AS key FROM part")
def dataset_keys(spark, sf):
    return load(spark, sf, "part").select("p_partkey", S.dataset_key(F.concat_ws("-", "p_brand", "p_type")).alias("key"))


_FIRST = "regexp_extract(text, '(?s)^(.*?[.!?])(?:\\s|$)', 1)"


@query("first_sentences", f"WITH {_TURNS} SELECT conv_id, turn, CASE WHEN {_FIRST} <> '' THEN {_FIRST} ELSE text END AS first, CASE WHEN len(w) <= 16 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:16], ' ') || '…' END AS quote FROM (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM t)")
def first_sentences(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", S.first_sentence(F.col("text")).alias("first"), S.short_quote(F.col("text")).alias("quote"))


@query("sentence_marks", f"WITH {_TURNS}, m AS (SELECT *, len(regexp_extract_all(text, '[=<>±×÷≤≥≈∑∏∫√∂∞∈∀∃^_\\\\]')) AS math, len(regexp_extract_all(text, '[(\\[]')) AS brackets, len(regexp_extract_all(text, '\\d')) AS digits FROM t) SELECT conv_id, turn, regexp_matches(text, '(?i)\\b(?:we|our (?:method|model|approach|results?|experiments?))\\b') AS own, math::BIGINT AS math, round(0.3 * ((math > 1)::INT + (brackets > 2)::INT + (digits > len(text) * 0.2)::INT), 3) AS clutter FROM m")
def sentence_marks(spark, sf):
    t = F.col("text")
    return _turns(spark, sf).select("conv_id", "turn", S.own_claim(t).alias("own"), S.math_symbols(t).cast("long").alias("math"), F.round(S.clutter(t), 3).alias("clutter"))


@query("clean_quotes", "WITH q AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark) SELECT item_id, upper(text[1:1]) || text[2:] AS quote FROM q")
def clean_quotes(spark, sf):
    """Every passage with connectives, a citation and a pointer put around it, cleaned again."""
    t = F.concat(F.lit("However, moreover, "), F.col("text"), F.lit(" [3, 4] (see Fig. 2)"))
    return load(spark, sf, "benchmark").select("item_id", S.clean_quote(t).alias("quote"))


@query("clean_meta", "WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') AS h FROM pages), b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS h FROM a) SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(h, '\\\\[a-zA-Z]+\\s*\\{([^{}]*)\\}', '\\1', 'g'), '\\\\[a-zA-Z]+|[${}]', '', 'g'), '\\s+', ' ', 'g')) AS text FROM b")
def clean_meta(spark, sf):
    return load(spark, sf, "pages").select("page_id", S.clean_meta(F.coalesce("html", F.lit(""))).alias("text"))


@query("valid_abstracts", "SELECT doc_id, coalesce(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) >= 20 AND len(regexp_extract_all(text, ',')) * 5 < len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')), false) AS valid FROM documents")
def valid_abstracts(spark, sf):
    return load(spark, sf, "documents").select("doc_id", S.valid_abstract(F.col("text")).alias("valid"))


@query("name_lists", "WITH n AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS a FROM nation GROUP BY 1) SELECT n_regionkey, CASE WHEN len(a) = 1 THEN a[1] WHEN len(a) = 2 THEN a[1] || ' and ' || a[2] ELSE a[1] || ', ' || a[2] || ' and ' || (len(a) - 2) || ' more' END AS names, len(a) || CASE WHEN len(a) = 1 THEN ' country' ELSE ' countrys' END AS counted FROM n")
def name_lists(spark, sf):
    n = load(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("a"))
    return n.select("n_regionkey", S.join_names(F.col("a")).alias("names"), S.plural(F.size("a"), "country").alias("counted"))


@query("candidate_reasons", "WITH r AS (SELECT p_partkey, p_size / 50.0 AS s, (p_partkey % 10) / 10.0 AS r, p_retailprice / 2000 AS c, 1990 + p_size AS y FROM part), l AS (SELECT p_partkey, y, unnest([{'v': s, 'i': 0, 't': 'close to the topic'}, {'v': r, 'i': 1, 't': 'recent'}, {'v': c, 'i': 2, 't': 'often cited'}]) AS x FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY x.v DESC, x.i) AS n FROM l WHERE x.v > 0) SELECT p_partkey, string_agg(x.t, ', ' ORDER BY n) || ', ' || any_value(y) AS why FROM k WHERE n <= 2 GROUP BY 1")
def candidate_reasons(spark, sf):
    why = S.explain(F.col("p_size") / 50.0, (F.col("p_partkey") % 10) / 10.0, F.col("p_retailprice") / 2000, 1990 + F.col("p_size"))
    return load(spark, sf, "part").select("p_partkey", why.alias("why"))


@query("aligned_spans", "SELECT p_partkey, length(p_brand) + 2 AS start, p_brand || '  ' AS before, p_type AS span FROM part")
def aligned_spans(spark, sf):
    """Each part's type, without blanks and in lower case, is found again behind its brand."""
    context = F.concat(F.col("p_brand"), F.lit("  "), F.col("p_type"))
    p = load(spark, sf, "part").select("p_partkey", "p_type", context.alias("c"), S.align_span(F.regexp_replace(F.lower("p_type"), r"\s+", ""), context).alias("start"))
    return p.select("p_partkey", "start", S.around_span(F.col("c"), F.col("start"), F.length("p_type")).alias("s")).select("p_partkey", "start", "s.before", "s.span")


@query("nice_steps", "WITH r AS (SELECT p_brand, (max(p_retailprice) - min(p_retailprice)) / 5 AS raw FROM part GROUP BY 1 HAVING max(p_retailprice) > min(p_retailprice)), s AS (SELECT p_brand, raw, pow(10.0, floor(log10(raw))) AS p FROM r) SELECT p_brand, p * CASE WHEN raw / p <= 1 THEN 1 WHEN raw / p <= 2 THEN 2 WHEN raw / p <= 5 THEN 5 ELSE 10 END AS step FROM s")
def nice_steps(spark, sf):
    r = load(spark, sf, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("a"), F.max("p_retailprice").alias("b")).where("b > a")
    return r.select("p_brand", S.nice_step(F.col("a"), F.col("b"), 5).alias("step"))


@query("search_terms", "SELECT item_id, array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower('title:\"' || text || '\" AND NOT x'), '\\b[a-z]+:|\\b(?:and|or|not|andnot)\\b|[^\\p{L}\\p{N}\\s.-]', ' ', 'g')), '\\s+'), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]'))[1:12], ' ') AS terms FROM benchmark")
def search_terms(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", S.search_terms(F.concat(F.lit('title:"'), F.col("text"), F.lit('" AND NOT x'))).alias("terms"))


@query("containing_chunks", f"WITH {_TURNS}, s AS (SELECT conv_id AS doc, turn AS \"index\", CASE WHEN {_FIRST} <> '' THEN {_FIRST} ELSE text END AS x FROM t) SELECT doc, 0 AS section, s.\"index\", min(t.turn) AS chunk FROM s JOIN t ON doc = conv_id AND (x = '' OR strpos(t.text, x) > 0) GROUP BY ALL")
def containing_chunks(spark, sf):
    """The first sentence of every turn, looked up among the turns of its conversation."""
    t = _turns(spark, sf).select(F.col("conv_id").alias("doc"), F.lit(0).alias("section"), F.col("turn").alias("index"), "text")
    return lookups.containing_chunk(t.withColumn("text", S.first_sentence(F.col("text"))), t.withColumnRenamed("index", "chunk"))


@query("sentence_offsets", f"WITH {_TURNS} SELECT conv_id, turn, (coalesce(sum(len(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"start\" FROM t")
def sentence_offsets(spark, sf):
    t = _turns(spark, sf).select(F.col("conv_id").alias("doc"), F.col("conv_id").alias("chunk"), F.col("turn").alias("index"), "text")
    return lookups.sentence_offsets(t).select(F.col("doc").alias("conv_id"), F.col("index").alias("turn"), "start")


_CORE = "regexp_replace(regexp_replace(regexp_replace(lower({}), '^[a-z][a-z0-9+.-]*://', ''), '^www\\.', ''), '[/.,;:)]+$', '')"


@query("links_outside", f"WITH l AS (SELECT page_id % 10 AS doc, url, {_CORE.format('url')} AS core FROM pages), b AS (SELECT DISTINCT page_id % 10 AS doc, {_CORE.format('url')} AS core FROM pages WHERE page_id % 3 = 0) SELECT doc, url FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc = l.doc AND b.core = l.core)")
def links_outside(spark, sf):
    p = load(spark, sf, "pages").select((F.col("page_id") % 10).alias("doc"), "page_id", "url")
    cited = p.where("page_id % 3 = 0").select("doc", F.concat(F.regexp_replace("url", r"^https?://(?:www\.)?", "http://www."), F.lit("/")).alias("url"))
    return lookups.links_outside(p.select("doc", "url"), cited)


@query("distinct_links", f"WITH l AS (SELECT page_id % 10 AS doc, page_id AS position, url, {_CORE.format('url')} AS core FROM pages) SELECT doc, min(position) AS position, core FROM l WHERE len(core) > 8 GROUP BY doc, core")
def distinct_links(spark, sf):
    p = load(spark, sf, "pages").select((F.col("page_id") % 10).alias("doc"), F.col("page_id").alias("position"), "url")
    return lookups.distinct_links(p, ["doc"]).select("doc", "position", "core")


@query("kv_scan", "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE starts_with(c_name, 'Customer#0000000')")
def kv_scan(spark, sf):
    return lookups.kv_scan(load(spark, sf, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value")), "Customer#0000000")


@query("kv_put", "WITH l AS (SELECT o_custkey AS key, arg_max(CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END, o_orderkey) AS value FROM orders GROUP BY 1) SELECT c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_custkey NOT IN (SELECT key FROM l) UNION ALL SELECT key, value FROM l WHERE value <> ''")
def kv_put(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("value"), F.col("o_orderkey").alias("at"))
    return lookups.kv_put(c, o)


@query("layered_read", "SELECT coalesce(s_suppkey, c_custkey) AS key, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE c_name END AS value FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def layered_read(spark, sf):
    return lookups.layered(load(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value")), load(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value")))


@query("gravest_errors", "WITH k AS (SELECT user_id, CASE event_id % 6 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 6 END AS r FROM events WHERE event_type <> 'view') SELECT user_id, ['unreachable', 'rate-limited', 'server-error', 'bad-response', 'not-found', 'other'][min(r)] AS kind FROM k GROUP BY 1")
def gravest_errors(spark, sf):
    kinds = F.array(*map(F.lit, ("not-found", "bad-response", "server-error", "rate-limited", "unreachable", "other")))
    e = load(spark, sf, "events").where("event_type <> 'view'").select("user_id", F.get(kinds, (F.col("event_id") % 6).cast("int")).alias("kind"))
    return lookups.gravest_error(e, ["user_id"])


@query("topic_search", "WITH a AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part), x AS (SELECT * FROM a WHERE r <= 25), b AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), y AS (SELECT * FROM b WHERE r <= 25) SELECT coalesce(x.p_partkey, y.p_partkey) AS p_partkey, coalesce(x.p_name, y.p_name) AS title, x.r AS rank_0, y.r AS rank_1, round(coalesce(1.0 / (60 + x.r), 0) + coalesce(1.0 / (60 + y.r), 0), 12) AS score FROM x FULL JOIN y USING (p_partkey) ORDER BY score DESC, p_partkey LIMIT 20")
def topic_search(spark, sf):
    """Pages of 25 hits of two indexes, united; 20 come out."""
    p = load(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"), "p_size", "p_retailprice")

    def page(by):
        top = p.orderBy(F.desc(by), "p_partkey").limit(25)
        places = top.agg(F.array_sort(F.collect_list(F.struct((-F.col(by)).alias("k"), "p_partkey", "title"))).alias("a"))
        return places.select(F.posexplode("a").alias("rank", "x")).select("x.p_partkey", "x.title", (F.col("rank") + 1).alias("rank"))

    part = lambda i: F.coalesce(1.0 / (60 + F.col(f"rank_{i}")), F.lit(0.0))
    return lookups.topic_search(page("p_size"), page("p_retailprice"), "p_partkey", F.round(part(0) + part(1), 12))


@query("timeline", "SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS place, coalesce(year(o_orderdate) <> lag(year(o_orderdate)) OVER w, true) AS opens, (row_number() OVER w - 1) % 3 = 0 AS shown FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def timeline(spark, sf):
    return lookups.timeline(load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey", 3).drop("o_orderdate")


_LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents)"
_KIND = "CASE WHEN regexp_matches(line, '^\\s*```') THEN 'fence' WHEN fences % 2 = 1 THEN 'code' WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^#{1,6}\\s') THEN 'heading' WHEN regexp_matches(line, '^\\s*(?:[-*+]|\\d+[.)])\\s') THEN 'list' WHEN regexp_matches(line, '^\\s*\\|') THEN 'table' WHEN regexp_matches(line, '^\\s*>') THEN 'quote' ELSE 'paragraph' END"


@query("markdown_blocks", f"WITH {_LINES}, f AS (SELECT *, sum(regexp_matches(line, '^\\s*```')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM l), k AS (SELECT *, {_KIND} AS kind FROM f), c AS (SELECT *, (kind = 'heading' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY n))::INT AS cut FROM k), b AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY n)::BIGINT AS block FROM c) SELECT doc_id, block, kind, CASE WHEN kind = 'heading' THEN trim(regexp_replace(string_agg(line, chr(10) ORDER BY n), '^#+', '')) ELSE string_agg(line, chr(10) ORDER BY n) END AS text FROM b WHERE kind NOT IN ('blank', 'fence') GROUP BY doc_id, block, kind")
def markdown_blocks(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    return lookups.markdown_blocks(d, ["doc_id"]).drop("level")


@query("sparse_centroids", "WITH t AS (SELECT l_returnflag, l_partkey, sum(l_quantity) AS w FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_partkey, round(w / sqrt(sum(w * w) OVER (PARTITION BY l_returnflag)), 9) AS weight FROM t")
def sparse_centroids(spark, sf):
    t = load(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_partkey", F.col("l_quantity").alias("weight"))
    return lookups.sparse_centroid(t, "l_returnflag", "l_orderkey", "l_partkey", "weight").withColumn("weight", F.round("weight", 9))


@query("year_spans", "SELECT o_custkey, max(year(o_orderdate)) - min(year(o_orderdate)) AS span, bool_or(o_orderstatus = 'P') AS has_pending FROM orders GROUP BY 1")
def year_spans(spark, sf):
    return load(spark, sf, "orders").groupBy("o_custkey").agg((F.max(F.year("o_orderdate")) - F.min(F.year("o_orderdate"))).cast("long").alias("span"), F.max(F.col("o_orderstatus") == "P").alias("has_pending"))
