"""Registered queries of layout rules, evidence lists and collection helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import evidence, layout
from inkwell.plans.document_queries import _RULES, _SIGNALS, made_signals
from inkwell.plans.scalar_queries import _LINES
from inkwell.session import load

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: The lines of documents set on pages of 50: some get a caption's opener, a heading's number, cells or dot leaders; the foot
#: of a page is small, the first two lines are large.
_TEXT = "CASE WHEN n % 50 = 20 THEN 'Figure ' || (n // 50 + 1) || ': ' || t WHEN n % 17 = 5 THEN (n % 9 + 1) || ' Heading ' || left(t, 20) WHEN n % 13 = 6 THEN '12 4.5 ' || n WHEN n % 19 = 7 THEN left(t, 20) || ' ..... 12' ELSE t END"
_SET = f"""{_LINES}, lt AS (SELECT doc_id, n, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS t FROM l),
lx AS (SELECT doc_id, n, {_TEXT} AS text FROM lt WHERE t <> ''),
ln AS (SELECT doc_id AS doc, n // 50 AS page, n % 50 AS line, text, CASE WHEN n % 7 = 0 THEN 70.0 ELSE 50.0 END AS x, 60.0 + 14 * (n % 50) + CASE WHEN n % 50 >= 25 THEN 30 ELSE 0 END AS y,
least(500.0, len(text) * 5.0) AS width, CASE WHEN n % 50 >= 40 THEN 8.0 WHEN n <= 1 THEN 16.0 ELSE 10.0 END AS size, n % 17 = 5 AS bold, 0 AS "column" FROM lx)"""


def set_lines(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "t"))
    d = d.withColumn("t", F.trim(F.regexp_replace("t", r"\s+", " "))).where("t <> ''")
    text = F.expr("CASE WHEN n % 50 = 20 THEN concat('Figure ', n div 50 + 1, ': ', t) WHEN n % 17 = 5 THEN concat(n % 9 + 1, ' Heading ', left(t, 20)) WHEN n % 13 = 6 THEN concat('12 4.5 ', n) WHEN n % 19 = 7 THEN concat(left(t, 20), ' ..... 12') ELSE t END")
    d = d.withColumn("text", text)
    return d.select(
        F.col("doc_id").alias("doc"), F.expr("n div 50").alias("page"), (F.col("n") % 50).cast("long").alias("line"), "text", F.when(F.col("n") % 7 == 0, 70.0).otherwise(50.0).alias("x"),
        (60.0 + 14 * (F.col("n") % 50) + F.when(F.col("n") % 50 >= 25, 30).otherwise(0)).alias("y"), F.least(F.lit(500.0), F.length("text") * 5.0).alias("width"),
        F.when(F.col("n") % 50 >= 40, 8.0).when(F.col("n") <= 1, 16.0).otherwise(10.0).alias("size"), (F.col("n") % 17 == 5).alias("bold"), F.lit(0).alias("column"),
    )


_BODY = "bs AS (SELECT doc, max_by(size, (n, -size)) AS body FROM (SELECT doc, floor(size * 2 + 0.5) / 2 AS size, sum(len(text))::BIGINT AS n FROM ln GROUP BY 1, 2) GROUP BY 1)"


@query("glyph_fragments", "SELECT l_orderkey, l_linenumber, 800 - l_extendedprice / 50 AS y FROM lineitem WHERE 800 - l_extendedprice / 50 BETWEEN 0 AND 800 AND l_quantity * 20 < 600 AND l_linenumber % 3 <> 0")
def glyph_fragments(spark, sf):
    g = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 == 0, " ").otherwise("word").alias("text"), (F.col("l_quantity") * 20).alias("x"), (F.col("l_extendedprice") / 50).alias("y"), F.lit(20.0).alias("width"))
    return layout.fragments(g).select("l_orderkey", "l_linenumber", "y")


@query("layout_statistics", f"WITH {_SET}, {_BODY}, s AS (SELECT doc, count(DISTINCT page) AS pages, min(x) AS \"left\", max(x + width) AS \"right\", min(y) AS top, max(y) AS bottom, list_sort(list(width)) AS w FROM ln GROUP BY 1) SELECT doc, pages, \"left\", \"right\", top, bottom, w[floor(0.8 * (len(w) - 1))::BIGINT + 1] AS typical_width, body FROM s JOIN bs USING (doc)")
def layout_statistics(spark, sf):
    return layout.statistics(set_lines(spark, sf))


@query("footnotes", f"WITH {_SET}, {_BODY}, s AS (SELECT ln.*, size <= body - 0.5 AND y > 440 AS small FROM ln JOIN bs USING (doc)), w AS (SELECT doc, page, line, bool_and(small) OVER (PARTITION BY doc, page ORDER BY y DESC, line DESC) AS ok FROM s) SELECT doc, page, line FROM w WHERE ok")
def footnotes(spark, sf):
    return layout.footnotes(set_lines(spark, sf))


_OPENER = "(?i)^(fig(?:ure|\\.)?|table)\\s*(\\d+)\\s*[.:|]\\s*"


@query("caption_blocks", f"WITH {_SET}, o AS (SELECT *, regexp_matches(text, '{_OPENER}') AS opens, lag(y) OVER w AS py, lag(size) OVER w AS ps FROM ln WINDOW w AS (PARTITION BY doc, page ORDER BY line)), r AS (SELECT *, sum(coalesce(opens OR y - py > 1.8 * size OR abs(size - ps) > 0.5, true)::INT) OVER (PARTITION BY doc, page ORDER BY line) AS run FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY doc, page, run ORDER BY line) AS nth FROM r), g AS (SELECT doc, page, run, min_by(opens, line) AS yes, min(line) AS line, string_agg(text, ' ' ORDER BY line) AS a FROM k WHERE nth <= 15 GROUP BY ALL) SELECT doc, page, line, CASE WHEN lower(a) LIKE 'fig%' THEN 'figure' ELSE 'table' END AS kind, regexp_extract(a, '{_OPENER}', 2) AS label, regexp_replace(a, '{_OPENER}', '') AS text FROM g WHERE yes")
def caption_blocks(spark, sf):
    return layout.caption_blocks(set_lines(spark, sf))


@query("learned_heading_style", f"WITH {_SET}, v AS (SELECT doc, size, bold, count(*) AS votes FROM ln WHERE regexp_matches(text, '^\\d{{1,2}}(?:\\.\\d{{1,2}})*\\.?\\s+\\p{{Lu}}') AND len(text) <= 90 GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY votes DESC, size DESC, bold DESC) AS k FROM v) SELECT doc, size, bold, votes FROM r WHERE k = 1")
def learned_heading_style(spark, sf):
    return layout.learned_heading_style(set_lines(spark, sf))


@query("contents_lines", f"WITH {_SET} SELECT doc, page, line FROM ln WHERE regexp_matches(text, '\\.{{4,}}|(?:\\. ){{3,}}|^\\d{{0,2}}(?:\\.\\d+)*\\.?\\s*\\p{{Lu}}.*\\s{{2,}}\\d{{1,3}}$')")
def contents_lines(spark, sf):
    return layout.contents_lines(set_lines(spark, sf))


@query("paragraphs", f"WITH {_SET}, s AS (SELECT *, coalesce(page <> lag(page) OVER w OR y - lag(y) OVER w > 1.55 * size OR x - lag(x) OVER w > size, true)::INT AS st FROM ln WINDOW w AS (PARTITION BY doc ORDER BY page, line)), p AS (SELECT *, sum(st) OVER (PARTITION BY doc ORDER BY page, line)::BIGINT AS paragraph FROM s) SELECT doc, paragraph, min(page) AS page, string_agg(text, ' ' ORDER BY page, line) AS text FROM p GROUP BY doc, paragraph")
def paragraphs(spark, sf):
    return layout.paragraphs(set_lines(spark, sf))


@query("titles", f"WITH {_SET}, k AS (SELECT *, max(size) OVER (PARTITION BY doc) AS most FROM ln WHERE page = 0 AND line <= 40 AND NOT regexp_matches(text, '(?i)^(?:arxiv|preprint|published|proceedings|copyright|https?://|doi|vol\\.)') AND len(regexp_extract_all(text, '\\p{{L}}')) > 0.5 * len(text)), r AS (SELECT *, line - row_number() OVER (PARTITION BY doc ORDER BY line) AS run FROM k WHERE size >= most - 0.5), f AS (SELECT *, min(run) OVER (PARTITION BY doc) AS first FROM r) SELECT doc, string_agg(text, ' ' ORDER BY line) AS title FROM f WHERE run = first GROUP BY doc")
def titles(spark, sf):
    return layout.titles(set_lines(spark, sf))


@query("front_abstracts", f"WITH {_SET}, s AS (SELECT *, coalesce(page <> lag(page) OVER w OR y - lag(y) OVER w > 1.55 * size OR x - lag(x) OVER w > size, true)::INT AS st FROM ln WINDOW w AS (PARTITION BY doc ORDER BY page, line)), p AS (SELECT *, sum(st) OVER (PARTITION BY doc ORDER BY page, line)::BIGINT AS paragraph FROM s), q AS (SELECT doc, paragraph, min(page) AS page, string_agg(text, ' ' ORDER BY page, line) AS text FROM p GROUP BY doc, paragraph) SELECT doc, min_by(text, paragraph) AS abstract FROM q WHERE page = 0 AND len(text) >= 400 AND len(regexp_extract_all(text, '\\p{{L}}')) > 0.75 * len(text) GROUP BY doc")
def front_abstracts(spark, sf):
    return layout.front_abstract(layout.paragraphs(set_lines(spark, sf)))


@query("document_warnings", "WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, len(string_split(coalesce(text, ''), chr(10))) AS lines FROM documents) SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'text was cut' END, CASE WHEN chars / (lines // 50 + 1) < 80 THEN 'no text layer' END, CASE WHEN doc_id % 3 = 0 THEN 'no sections' END, CASE WHEN doc_id % 4 = 0 THEN 'no references' END, CASE WHEN lines // 50 + 1 >= 50 THEN 'long document' END], lambda x: x IS NOT NULL), '; ') AS warnings, CASE WHEN chars / (lines // 50 + 1) < 80 THEN 'image-only' WHEN chars < 1500 THEN 'too short' WHEN doc_id % 3 = 0 THEN 'no sections' END AS unusable FROM d")
def document_warnings(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines"))
    pages = F.expr("lines div 50 + 1")
    per = F.col("chars") / pages
    sections, refs = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(4), F.when(F.col("doc_id") % 4 == 0, 0).otherwise(9)
    quality = F.when(per < 80, "image-only").otherwise("good")
    return d.select("doc_id", F.array_join(layout.warnings(per, pages, sections, refs, F.col("doc_id") % 5 == 0), "; ").alias("warnings"), layout.unusable(F.col("chars"), sections, quality).alias("unusable"))


_PRINT = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@query("quoted_lines", f"WITH {_SET}, q AS (SELECT doc_id AS doc, doc_id AS quote_id, {_PRINT.format('text')} AS a FROM documents WHERE text IS NOT NULL), p AS (SELECT doc, page, line, {_PRINT.format('text')} AS part FROM ln) SELECT doc, quote_id, page, line FROM p JOIN q USING (doc) WHERE len(part) >= 14 AND strpos(a, part) > 0")
def quoted_lines(spark, sf):
    """The whole text of each document as a quote: its lines are found, those that were changed are not."""
    q = load(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("quote_id"), F.col("text").alias("quote"))
    return layout.quoted_lines(q, set_lines(spark, sf))


@query("lexicon_mentions", "WITH o AS (SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT c_custkey, n_name AS name, r_name AS domain, 2 AS n FROM o")
def lexicon_mentions(spark, sf):
    """Two spellings of each customer's nation in one sentence; names of several words must not be read as shorter ones."""
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    lex = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.regexp_replace(F.lower("n_name"), r"[^\p{L}\p{N}]+", "").alias("key"), F.col("n_name").alias("name"), F.col("r_name").alias("domain"))
    c = load(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit("Sent from "), F.replace("n_name", F.lit(" "), F.lit("-")), F.lit(" by way of "), F.lower("n_name"), F.lit("."))
    return evidence.mentions(c.select("c_custkey", text.alias("text")), lex, ["c_custkey"])


@query("smallest_gains", "WITH m AS (SELECT l_orderkey, l_discount * 100 AS value, ['pp', 'points', '%', 'ms'][l_linenumber % 4 + 1] AS unit, CASE WHEN l_returnflag = 'R' THEN 'up' ELSE 'down' END AS direction FROM lineitem), g AS (SELECT l_orderkey, min((value, unit)) AS g FROM m WHERE value > 0 AND (unit IN ('pp', 'points') OR (unit = '%' AND direction = 'up')) GROUP BY 1) SELECT l_orderkey, g[1] AS value, g[2] AS unit FROM g")
def smallest_gains(spark, sf):
    units = F.array(*map(F.lit, ("pp", "points", "%", "ms")))
    m = load(spark, sf, "lineitem").select("l_orderkey", (F.col("l_discount") * 100).alias("value"), F.get(units, F.col("l_linenumber") % 4).alias("unit"), F.when(F.col("l_returnflag") == "R", "up").otherwise("down").alias("direction"))
    return evidence.smallest_gain(m, ["l_orderkey"])


_FOUND = "f AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS rule, '{n}' AS id, {sev} AS severity FROM x WHERE {cond}" for i, (n, sev, cond) in enumerate(_RULES)) + "), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['major', 'moderate', 'minor', 'strength'], severity), rule) AS position FROM f)"


@query("reviewer_questions", f"WITH {_SIGNALS}, {_FOUND}, n AS (SELECT doc_id, id, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS place FROM p WHERE severity <> 'strength') SELECT doc_id, place AS position FROM n WHERE place <= greatest(5, least(8, n + 2))")
def reviewer_questions(spark, sf):
    from inkwell.operators import review

    return evidence.reviewer_questions(review.findings(made_signals(spark, sf))).select("doc_id", "position")


@query("detected_limitations", f"WITH {_SIGNALS}, {_FOUND}, g AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS rank FROM p WHERE severity IN ('major', 'moderate')), k AS (SELECT * FROM g WHERE rank <= 5) SELECT o_orderkey AS doc_id, coalesce(rank, 1) AS rank, rank IS NULL AS caveat FROM orders LEFT JOIN k ON o_orderkey = doc_id")
def detected_limitations(spark, sf):
    from inkwell.operators import review

    s = made_signals(spark, sf)
    return evidence.detected_limitations(s, review.findings(s)).select("doc_id", "rank", F.col("text").startswith("No rule found").alias("caveat"))


@query("distinct_evidence", "SELECT l_partkey, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL")
def distinct_evidence(spark, sf):
    e = load(spark, sf, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))
    return evidence.distinct_evidence(e, ["l_partkey"], ["l_suppkey"], "first")


@query("evidence_caps", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 3")
def evidence_caps(spark, sf):
    return evidence.capped(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber", 3)


@query("fresh_items", "WITH x AS (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey, l_linenumber) AS used FROM lineitem), y AS (SELECT *, sum((NOT used)::INT) OVER (PARTITION BY l_orderkey) AS f FROM x) SELECT l_orderkey, l_linenumber FROM y WHERE NOT used OR f < 2")
def fresh_items(spark, sf):
    x = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return evidence.fresh(x.drop("l_returnflag"), x.where("l_returnflag = 'R'"), ["l_orderkey"], "l_linenumber")


@query("merged_counts", "SELECT key, sum(n)::BIGINT AS n FROM (SELECT c_nationkey AS key, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY 1")
def merged_counts(spark, sf):
    c = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("n"))
    return evidence.merged_counts(c, load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("n")), keys=["key"])


@query("link_pages", "SELECT a.page_id % 10 AS doc, a.url, min(b.page_id) AS page FROM pages a JOIN pages b ON a.page_id % 10 = b.page_id % 10 AND strpos(b.url || ' ' || coalesce(b.html, ''), a.url) > 0 GROUP BY ALL")
def link_pages(spark, sf):
    p = load(spark, sf, "pages").select((F.col("page_id") % 10).alias("doc"), F.col("page_id").alias("page"), "url", F.concat("url", F.lit(" "), F.coalesce("html", F.lit(""))).alias("text"))
    return evidence.link_pages(p.select("doc", "url").distinct(), p.select("doc", "page", "text"))


@query("fallback_texts", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ' || p_brand WHEN 1 THEN p_type ELSE p_name END AS text FROM part")
def fallback_texts(spark, sf):
    s = F.when(F.col("p_partkey") % 3 == 0, F.array("p_name", "p_brand")).otherwise(F.array().cast("array<string>"))
    return load(spark, sf, "part").select("p_partkey", evidence.fallback_text(s, F.when(F.col("p_partkey") % 3 == 1, F.col("p_type")).otherwise(""), F.col("p_name")).alias("text"))


@query("durations", "SELECT event_id, CASE WHEN v < 1000 THEN floor(v + 0.5)::BIGINT || ' ms' WHEN v < 60000 THEN printf('%.1f', floor(v / 100 + 0.5) / 10) || ' s' ELSE (floor(v / 1000 + 0.5)::BIGINT // 60) || ' min ' || (floor(v / 1000 + 0.5)::BIGINT % 60) || ' s' END AS took FROM (SELECT event_id, value * CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 40 ELSE 900 END AS v FROM events)")
def durations(spark, sf):
    v = F.col("value") * F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 40).otherwise(900)
    return load(spark, sf, "events").select("event_id", evidence.duration(v).alias("took"))


@query("near_phrases", "WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_name || ' ' || p_brand, ' ') AS b FROM part) SELECT p_partkey, list_sort(a) = list_sort(b) OR len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.5 OR (len(a) = 1 AND len(b) > 1 AND a[1] = list_aggregate(list_transform(b, lambda w: left(w, 1)), 'string_agg', '')) AS near FROM p")
def near_phrases(spark, sf):
    a, b = F.split("p_name", " "), F.split(F.concat_ws(" ", "p_name", "p_brand"), " ")
    return load(spark, sf, "part").select("p_partkey", evidence.near_phrases(a, b).alias("near"))


@query("queue_progress", "WITH j AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'waiting' END AS s FROM orders), g AS (SELECT o_custkey, count(*) FILTER (WHERE s = 'done') AS done, count(*) FILTER (WHERE s = 'failed') AS failed FROM j GROUP BY 1) SELECT *, CASE WHEN done >= 9 THEN 1.0 ELSE least(0.97, done / 9) END::DOUBLE AS share FROM g")
def queue_progress(spark, sf):
    s = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("waiting")
    return evidence.progress(load(spark, sf, "orders").select("o_custkey", s.alias("status")), ["o_custkey"])
