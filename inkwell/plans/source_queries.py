"""Registered queries of sources: identifiers, record mappers, names, files, briefs and interval joins. Their inputs are written
from the driver's tables in the services' own formats, so that the mappers read what they would read."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import answering, briefing, review, zoning
from inkwell.session import load
from inkwell.sources import files, identifiers, records
from inkwell.streaming import trace

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_NUMBER = "printf('%02d%02d.%05d', o_orderkey % 9 + 15, o_orderkey % 12 + 1, o_orderkey % 99999 + 1)"


def _typed(spark, sf):
    k = F.col("o_orderkey")
    number = F.format_string("%02d%02d.%05d", k % 9 + 15, k % 12 + 1, k % 99999 + 1)
    form = (k % 7).cast("int")
    typed = F.element_at(
        F.array(
            F.concat(F.lit("arXiv:"), number, F.lit("v2")), F.concat(F.lit("https://arxiv.org/abs/"), number), F.concat(F.lit("doi:10.1000/AbC"), k.cast("string")), F.concat(F.lit("https://doi.org/10.48550/arXiv."), number),
            F.concat(F.lit("https://example.org/a"), k.cast("string"), F.lit(".pdf")), F.concat(F.lit("  some  topic words "), k.cast("string")), F.concat(F.lit("https://dx.doi.org/10.1000/x"), k.cast("string")),
        ),
        form + 1,
    )
    return load(spark, sf, "orders").select("o_orderkey", typed.alias("typed"))


@query("typed_identifiers", f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1, 3) THEN 'arxiv' WHEN o_orderkey % 7 IN (2, 6) THEN 'doi' WHEN o_orderkey % 7 = 4 THEN 'pdf-url' ELSE 'topic' END AS kind, CASE WHEN o_orderkey % 7 IN (0, 1, 3) THEN {_NUMBER} END AS arxiv, CASE o_orderkey % 7 WHEN 2 THEN '10.1000/abc' || o_orderkey WHEN 3 THEN '10.48550/arxiv.' || {_NUMBER} WHEN 6 THEN '10.1000/x' || o_orderkey END AS doi, CASE o_orderkey % 7 WHEN 5 THEN 'some topic words ' || o_orderkey END AS query FROM orders")
def typed_identifiers(spark, sf):
    return identifiers.parse_inputs(_typed(spark, sf), "typed").select("o_orderkey", "kind", "arxiv", "doi", "query")


@query("record_ids", f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1, 3) THEN 'arxiv:' || {_NUMBER} WHEN o_orderkey % 7 = 2 THEN 'doi:10.1000/abc' || o_orderkey WHEN o_orderkey % 7 = 6 THEN 'doi:10.1000/x' || o_orderkey WHEN o_orderkey % 7 = 4 THEN 'url:' || left(sha256('https://example.org/a' || o_orderkey || '.pdf'), 12) END AS id FROM orders")
def record_ids(spark, sf):
    x = identifiers.parse_inputs(_typed(spark, sf), "typed")
    return x.select("o_orderkey", identifiers.record_id(F.col("kind"), F.col("arxiv"), F.col("doi"), F.col("url")).alias("id"))


@query("split_batches", f"WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ['arXiv:' || {_NUMBER}, '10.1000/b' || o_orderkey] ELSE ['two words, and ' || o_orderkey] END AS p FROM orders) SELECT o_orderkey, unnest(p) AS part FROM b")
def split_batches(spark, sf):
    k = F.col("o_orderkey")
    number = F.format_string("%02d%02d.%05d", k % 9 + 15, k % 12 + 1, k % 99999 + 1)
    text = F.when(k % 2 == 0, F.concat(F.lit("arXiv:"), number, F.lit(", 10.1000/b"), k.cast("string"), F.lit("; arXiv:"), number)).otherwise(F.concat(F.lit("two words, and "), k.cast("string")))
    return identifiers.split_batches(load(spark, sf, "orders").select("o_orderkey", text.alias("t")), "o_orderkey", "t")


@query("person_names", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Given Family' || c_custkey WHEN c_custkey % 3 = 1 THEN 'Given Family' || c_custkey ELSE 'A, B, C' || c_custkey END AS name FROM customer")
def person_names(spark, sf):
    k = F.col("c_custkey").cast("string")
    typed = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Family"), k, F.lit(", Given"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" Given   Family"), k)).otherwise(F.concat(F.lit("A, B, C"), k))
    return load(spark, sf, "customer").select("c_custkey", identifiers.person_name(typed).alias("name"))


@query("file_titles", "SELECT p_partkey, replace(p_name, '-', ' ') || ' ' || p_partkey AS title FROM part")
def file_titles(spark, sf):
    path = F.concat(F.lit("https://host/dir/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("--"), F.col("p_partkey").cast("string"), F.lit(".pdf?download=1#page=2"))
    return load(spark, sf, "part").select("p_partkey", files.title_of_file(path).alias("title"))


@query("datacite_records", "SELECT s_suppkey, s_name AS title, 'Ann Lee' || s_suppkey || '|Solo Name' AS authors, 'About ' || s_name AS abstract, '2019-03-0' || (s_suppkey % 9 + 1) AS published, 2019 AS year, s_suppkey % 50 AS citations, '1903.' || printf('%05d', s_suppkey) AS arxiv, '10.48550/arxiv.1903.' || printf('%05d', s_suppkey) AS doi FROM supplier")
def datacite_records(spark, sf):
    k = F.col("s_suppkey")
    attributes = F.struct(
        F.concat(F.lit("10.48550/ARXIV.1903."), F.format_string("%05d", k)).alias("doi"), F.array(F.struct(F.concat(F.lit(" "), "s_name").alias("title"))).alias("titles"), F.lit(2019).alias("publicationYear"), (k % 50).cast("int").alias("citationCount"),
        F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit("Ann").alias("givenName"), F.concat(F.lit("Lee"), k.cast("string")).alias("familyName")), F.struct(F.lit("Name, Solo").alias("name"), F.lit(None).cast("string").alias("givenName"), F.lit(None).cast("string").alias("familyName"))).alias("creators"),
        F.array(F.struct(F.lit("2020").alias("date"), F.lit("Updated").alias("dateType")), F.struct(F.concat(F.lit("2019-03-0"), (k % 9 + 1).cast("string"), F.lit("T10:00:00Z")).alias("date"), F.lit("Submitted").alias("dateType"))).alias("dates"),
        F.array(F.struct(F.lit("notes").alias("description"), F.lit("Other").alias("descriptionType")), F.struct(F.concat(F.lit("About   "), "s_name").alias("description"), F.lit("Abstract").alias("descriptionType"))).alias("descriptions"),
    )
    raw = load(spark, sf, "supplier").select("s_suppkey", F.to_json(F.struct(F.struct(attributes.alias("attributes")).alias("data"))).alias("json"))
    return records.map_datacite(raw, "s_suppkey", "json").select("s_suppkey", "title", F.array_join("authors", "|").alias("authors"), "abstract", "published", "year", "citations", "arxiv", "doi")


@query("openalex_records", "SELECT s_suppkey, s_name AS title, 'Ann Lee' AS authors, 'deep words here deep' AS abstract, '2018-0' || (s_suppkey % 9 + 1) || '-11' AS published, 2018 AS year, 'Venue ' || s_suppkey AS venue, s_suppkey % 70 AS citations, '10.1000/w' || s_suppkey AS doi, 'https://x.org/' || s_suppkey || '.pdf' AS url FROM supplier")
def openalex_records(spark, sf):
    k = F.col("s_suppkey")
    key = k.cast("string")
    at = F.struct(F.concat(F.lit("https://x.org/"), key).alias("landing_page_url"), F.concat(F.lit("https://x.org/"), key, F.lit(".pdf")).alias("pdf_url"), F.struct(F.concat(F.lit("Venue "), key).alias("display_name")).alias("source"))
    index = F.create_map(F.lit("deep"), F.array(F.lit(0), F.lit(3)), F.lit("words"), F.array(F.lit(1)), F.lit("here"), F.array(F.lit(2), F.lit(-1)))
    w = F.struct(F.concat(F.lit("https://doi.org/10.1000/W"), key).alias("doi"), F.col("s_name").alias("title"), F.lit(2018).alias("publication_year"), F.concat(F.lit("2018-0"), (k % 9 + 1).cast("string"), F.lit("-11")).alias("publication_date"), (k % 70).cast("int").alias("cited_by_count"), at.alias("primary_location"), F.array(F.struct(F.struct(F.lit(None).cast("string").alias("display_name")).alias("author"), F.lit("Lee, Ann").alias("raw_author_name"))).alias("authorships"), index.alias("abstract_inverted_index"))
    raw = load(spark, sf, "supplier").select("s_suppkey", F.to_json(w).alias("json"))
    return records.map_openalex(raw, "s_suppkey", "json").select("s_suppkey", "title", F.array_join("authors", "|").alias("authors"), "abstract", "published", "year", "venue", "citations", "doi", "url")


@query("crossref_records", "SELECT s_suppkey, s_name AS title, 'Ann Lee' AS authors, 'Plain text.' AS abstract, CASE s_suppkey % 4 WHEN 0 THEN '2017-05-02' WHEN 1 THEN '2016-04' WHEN 2 THEN '2015' ELSE '2014-01-09' END AS published, CASE s_suppkey % 4 WHEN 0 THEN 2017 WHEN 1 THEN 2016 WHEN 2 THEN 2015 ELSE 2014 END AS year, 'Journal' AS venue, '10.1000/c' || s_suppkey AS doi FROM supplier")
def crossref_records(spark, sf):
    k = F.col("s_suppkey")
    parts = lambda *x: F.struct(F.array(F.array(*[F.lit(v) for v in x])).alias("date-parts"))
    none = F.lit(None).cast("struct<`date-parts`:array<array<int>>>")
    m = F.struct(
        F.array(F.concat(F.lit("<i></i>"), "s_name")).alias("title"), F.array(F.struct(F.lit("Ann").alias("given"), F.lit("Lee").alias("family"))).alias("author"), F.lit("<jats:title>Abstract</jats:title><jats:p>Plain<jats:sup>1</jats:sup> text.</jats:p>").alias("abstract"),
        F.when(k % 4 == 0, parts(2017, 5, 2)).otherwise(none).alias("published"), F.when(k % 4 == 1, parts(2016, 4)).otherwise(none).alias("issued"), F.when(k % 4 == 2, parts(2015)).otherwise(none).alias("published-online"), parts(2014, 1, 9).alias("created"),
        F.array(F.lit("Journal")).alias("container-title"), F.concat(F.lit("10.1000/C"), k.cast("string")).alias("DOI"),
    )
    raw = load(spark, sf, "supplier").select("s_suppkey", F.to_json(F.struct(m.alias("message"))).alias("json"))
    return records.map_crossref(raw, "s_suppkey", "json").select("s_suppkey", "title", F.array_join("authors", "|").alias("authors"), "abstract", "published", "year", "venue", "doi")


@query("scholar_hints", "SELECT s_suppkey, s_suppkey % 30 AS citations, '2001.' || printf('%05d', s_suppkey) AS arxiv, '10.1000/s' || s_suppkey AS doi, CASE WHEN s_suppkey % 2 = 0 THEN 'https://x.org/f.pdf' END AS url FROM supplier")
def scholar_hints(spark, sf):
    k = F.col("s_suppkey")
    s = F.struct(F.struct(F.format_string("2001.%05d", k).alias("ArXiv"), F.concat(F.lit("10.1000/S"), k.cast("string")).alias("DOI")).alias("externalIds"), (k % 30).cast("int").alias("citationCount"), F.struct(F.when(k % 2 == 0, "https://x.org/f.pdf").otherwise("https://x.org/page").alias("url")).alias("openAccessPdf"))
    raw = load(spark, sf, "supplier").select("s_suppkey", F.to_json(s).alias("json"))
    return records.map_scholar(raw, "s_suppkey", "json").select("s_suppkey", "citations", "arxiv", "doi", "url")


@query("resolved_preprints", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 't' || o_orderkey WHEN o_orderkey % 3 = 0 THEN 'd' || o_orderkey WHEN o_orderkey % 5 = 0 THEN 'l' || o_orderkey WHEN o_orderkey % 7 = 0 THEN 's' || o_orderkey END AS arxiv, CASE WHEN o_orderkey % 2 = 0 THEN 'typed' WHEN o_orderkey % 3 = 0 THEN 'doi' WHEN o_orderkey % 5 = 0 THEN 'link' WHEN o_orderkey % 7 = 0 THEN 'title' END AS via, 'https://arxiv.org/pdf/x' || CASE WHEN o_orderkey % 4 = 0 THEN 'v3' ELSE '' END AS file FROM orders")
def resolved_preprints(spark, sf):
    k = F.col("o_orderkey")
    of = lambda m, c: F.when(k % m == 0, F.concat(F.lit(c), k.cast("string")))
    r = records.resolution(of(2, "t"), of(3, "d"), of(5, "l"), of(7, "s"))
    link = records.version_link(F.lit("x"), F.when(k % 4 == 0, 3))
    return load(spark, sf, "orders").select("o_orderkey", r.alias("r"), link.alias("file")).select("o_orderkey", "r.arxiv", "r.via", "file")


@query("title_matches", "WITH p AS (SELECT trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS k, min(p_brand || p_partkey) AS a FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT p_partkey, a AS arxiv FROM part LEFT JOIN p ON k = trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g'))")
def title_matches(spark, sf):
    p = load(spark, sf, "part")
    preprints = p.where("p_partkey % 2 = 0").select(F.upper("p_name").alias("title"), F.concat("p_brand", F.col("p_partkey").cast("string")).alias("arxiv"))
    papers = p.select("p_partkey", F.concat("p_name", F.lit(".")).alias("title"), F.lit(None).cast("string").alias("arxiv"))
    return records.match_titles(papers, preprints).select("p_partkey", "arxiv")


@query("markdown_briefs", "WITH n AS (SELECT l_orderkey, string_agg('| ' || l_quantity::BIGINT || ' | ' || l_returnflag || ' |', chr(10) ORDER BY l_quantity::BIGINT, l_returnflag) AS t FROM lineitem GROUP BY 1) SELECT l_orderkey AS doc_id, '# Order ' || l_orderkey || chr(10) || chr(10) || '## Key numbers' || chr(10) || chr(10) || t || chr(10) AS value FROM n")
def markdown_briefs(spark, sf):
    n = F.struct(F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("label"))
    x = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(n)).alias("n"))
    numbers = F.transform("n", lambda v: F.struct(v["q"].cast("string").alias("value"), v["label"].alias("label")))
    none = F.array().cast("array<struct<severity:string,title:string>>")
    b = x.select("doc_id", F.concat(F.lit("Order "), F.col("doc_id").cast("string")).alias("title"), F.array().cast("array<string>").alias("summary"), none.alias("findings"), numbers.alias("numbers"), F.array().cast("array<struct<label:string,score:int>>").alias("axes"))
    return files.markdown(b)


@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf):
    return trace.windowed_counts(load(spark, sf, "events").select("ts", "event_type"), "ts", "event_type")


@query("rhetorical_map", "WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id AS \"index\", event_type AS zone, round(i / greatest(1, n - 1), 4) AS position FROM e")
def rhetorical_map(spark, sf):
    e = load(spark, sf, "events").select("user_id", F.col("event_id").alias("index"), F.col("event_type").alias("zone"))
    return zoning.rhetorical_map(e, "user_id")


@query("overlapping_spans", "WITH s AS (SELECT l_orderkey AS doc, l_linenumber * 10 AS a, l_linenumber * 10 + 10 AS b FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), p AS (SELECT o_orderkey AS doc, 5 AS x, 25 AS y FROM orders) SELECT doc, a AS \"start\" FROM p JOIN s USING (doc) WHERE a < y AND b > x")
def overlapping_spans(spark, sf):
    s = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 10).alias("end")).distinct()
    p = load(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(5).alias("span_start"), F.lit(25).alias("span_end"))
    return answering.overlapping(p, s).select("doc", "start")


@query("compared_systems", "WITH s AS (SELECT p_size, replace(p_brand, '#', '') AS b FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_size, b, count(*) AS n FROM s GROUP BY ALL) SELECT p_size AS doc_id, b AS system, n FROM n QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY n DESC, b) <= 12")
def compared_systems(spark, sf):
    name = F.replace("p_brand", F.lit("#"), F.lit(""))
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("It uses "), name)).otherwise(F.concat(F.lit("It outperforms "), name, F.lit(" and "), name, F.lit(" again")))
    return briefing.compared_systems(load(spark, sf, "part").select(F.col("p_size").alias("doc_id"), text.alias("text")))


@query("reference_signals", "SELECT c_custkey AS doc_id, count(o_orderkey) AS \"references\", median(2000 - year(o_orderdate)) AS median_age, round(avg((2000 - year(o_orderdate) <= 3)::INT), 9) AS recent_share, round(avg((o_orderstatus = 'F')::INT), 9) AS self_share FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def reference_signals(spark, sf):
    s = load(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"))
    r = load(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.year("o_orderdate").alias("year"), F.lit(2000).alias("paper_year"), (F.col("o_orderstatus") == "F").alias("own"))
    x = review.with_references(s, r)
    return x.select("doc_id", "references", "median_age", F.round("recent_share", 9).alias("recent_share"), F.round("self_share", 9).alias("self_share"))
