"""Registered text, source and parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import scalars as S
from inkwell.functions import text as T
from inkwell.operators import segment, sequence, summarize
from inkwell.session import dealt, load, spread
from inkwell.sources import files, identifiers, records

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _docs(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


_D = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_W = "[\\p{L}\\p{N}]+(?:[''’-][\\p{L}\\p{N}]+)*"


@query("word_counts", f"WITH {_D} SELECT doc_id, len(regexp_extract_all(text, '{_W}'))::BIGINT AS words, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> ''))::BIGINT AS blanked FROM d")
def word_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("words"), T.word_count(F.col("text")).cast("long").alias("blanked"))


@query("fingerprint", f"WITH {_D} SELECT doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS fingerprint FROM d")
def fingerprint(spark, sf):
    return _docs(spark, sf).select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


@query("looks_like_prose", f"WITH {_D}, v AS (SELECT doc_id, text, regexp_replace(text, '\\s+', '', 'g') AS seen FROM d) SELECT doc_id, coalesce(len(text) <= 1500 AND len(seen) > 0 AND len(regexp_extract_all(seen, '\\p{{L}}')) / len(seen) >= 0.55 AND len(regexp_extract_all(seen, '\\p{{N}}')) / len(seen) <= 0.3 AND len(list_filter(string_split_regex(text, '\\s+'), lambda w: regexp_matches(w, '\\p{{L}}{{2,}}'))) >= 4, false) AS prose FROM v")
def looks_like_prose(spark, sf):
    return _docs(spark, sf).select("doc_id", T.looks_like_prose(F.col("text")).alias("prose"))


_SYL = "CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(w, '([^laeiouy])es$|([^laeiouytd])ed$|([^laeiouy])e$', '\\1\\2\\3'), '^y', ''), '[aeiouy]+'))) END"


@query("syllables", f"WITH {_D}, x AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_W}')) AS word FROM d), l AS (SELECT doc_id, regexp_replace(lower(word), '[^a-z]', '', 'g') AS w FROM x WHERE regexp_matches(word, '\\p{{L}}')) SELECT doc_id, count(*) AS words, sum({_SYL})::BIGINT AS syllables FROM l GROUP BY 1")
def syllables(spark, sf):
    w = _docs(spark, sf).select("doc_id", F.explode(T.words(F.col("text"))).alias("word")).where(F.col("word").rlike(r"\p{L}"))
    return w.groupBy("doc_id").agg(F.count("*").alias("words"), F.sum(T.syllables(F.col("word"))).cast("long").alias("syllables"))


@query("flesch_verdict", f"WITH {_D}, x AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_W}')) AS word FROM d), l AS (SELECT doc_id, regexp_replace(lower(word), '[^a-z]', '', 'g') AS w FROM x WHERE regexp_matches(word, '\\p{{L}}')), a AS (SELECT doc_id, count(*) AS n, sum({_SYL}) AS s FROM l GROUP BY 1), f AS (SELECT doc_id, floor((206.835 - 1.015 * 20 - 84.6 * (s / n)) * 10 + 0.5) / 10 AS flesch FROM a) SELECT doc_id, flesch, CASE WHEN flesch >= 60 THEN 'plain' WHEN flesch >= 50 THEN 'fairly hard' WHEN flesch >= 30 THEN 'hard' ELSE 'very hard' END AS verdict FROM f")
def flesch_verdict(spark, sf):
    s = syllables(spark, sf)
    f = s.select("doc_id", T.rounded(T.flesch(F.lit(20), F.col("syllables") / F.col("words")), 1).alias("flesch"))
    return f.withColumn("verdict", T.verdict(F.col("flesch"), [(60, "plain"), (50, "fairly hard"), (30, "hard")], "very hard"))


@query("url_core", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://', ''), '^www\\.', ''), '[/.,;:)]+$', '') AS core FROM pages")
def url_core(spark, sf):
    return load(spark, sf, "pages").select("page_id", T.url_core(F.col("url")).alias("core"))


@query("truncated", f"WITH {_D}, h AS (SELECT doc_id, text, text[1:119] AS head, len(text[1:119]) - len(regexp_extract(text[1:119], '[^ ]*$')) AS b FROM d) SELECT doc_id, CASE WHEN len(text) <= 120 THEN text ELSE CASE WHEN b - 1 > 72 THEN head[1:b - 1] ELSE head END || '…' END AS short FROM h")
def truncated(spark, sf):
    return _docs(spark, sf).select("doc_id", T.truncate(F.col("text"), 120).alias("short"))


@query("compact_counts", "SELECT l_quantity, CASE WHEN v >= 10000 THEN floor(v / 1000 + 0.5)::BIGINT || 'k' WHEN v >= 1000 THEN printf('%.1f', floor(v / 100 + 0.5) / 10) || 'k' ELSE v::VARCHAR END AS shown FROM (SELECT DISTINCT l_quantity, (l_quantity * l_quantity * 7)::BIGINT AS v FROM lineitem)")
def compact_counts(spark, sf):
    v = load(spark, sf, "lineitem").select("l_quantity").distinct()
    return v.select("l_quantity", T.compact_count((F.col("l_quantity") * F.col("l_quantity") * 7).cast("long")).alias("shown"))


@query("content_ids", "SELECT page_id, left(sha256(html), 12) AS upload_id FROM pages")
def content_ids(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.substring(F.sha2(F.encode("html", "UTF-8"), 256), 1, 12).alias("upload_id"))


@query("input_kinds", "SELECT page_id, CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '(?i)\\.pdf$') THEN 'pdf-url' ELSE 'url' END AS kind, url FROM pages")
def input_kinds(spark, sf):
    p = load(spark, sf, "pages").select("page_id", F.col("url").alias("typed"))
    return identifiers.parse_inputs(p, "typed").select("page_id", "kind", "url")


_HTML = r'''WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&#39;', chr(39)), '&amp;', '&') AS h FROM a)
SELECT page_id, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text FROM b'''


@query("html_text", _HTML)
def html_text(spark, sf):
    return load(spark, sf, "pages").select("page_id", files.html_text(F.col("html")).alias("text"))


@query("inverted_abstract", f"WITH {_D} SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ') AS abstract FROM d WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) > 0")
def inverted_abstract(spark, sf):
    w = _docs(spark, sf).select("doc_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("p", "w"))
    m = w.groupBy("doc_id", "w").agg(F.collect_list("p").alias("p")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "p"))).alias("m"))
    return m.select("doc_id", records.inverted_abstract(F.col("m")).alias("abstract"))


@query("merged_records", "SELECT coalesce(s_suppkey, c_custkey) AS k, coalesce(s_name, c_name) AS title, coalesce(s_acctbal, c_acctbal) AS score FROM (SELECT * FROM supplier WHERE s_acctbal > 0) FULL JOIN customer ON s_suppkey = c_custkey")
def merged_records(spark, sf):
    none = {c: F.lit(None).cast(k) for c, k in (("authors", "array<string>"), ("abstract", "string"), ("published", "string"), ("year", "int"), ("venue", "string"), ("arxiv", "string"), ("doi", "string"), ("url", "string"))}
    s = load(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("citations")).withColumns(none)
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("citations")).withColumns(none)
    return records.merge(s, c, "k").select("k", "title", F.col("citations").alias("score"))


@query("extracted_links", r"SELECT page_id, regexp_replace(url, '[.,;:!?)\]]+$', '') AS link, 0 AS position FROM pages UNION ALL SELECT page_id, 'https://example.org/p' || page_id, 1 FROM pages")
def extracted_links(spark, sf):
    """Links set into a sentence, twice and with punctuation behind them."""
    other = F.concat(F.lit("https://example.org/p"), F.col("page_id").cast("string"))
    told = F.concat(F.lit("See "), "url", F.lit(", ("), other, F.lit("); again "), "url", F.lit(' or <a href="'), other, F.lit('">.'))
    return load(spark, sf, "pages").select("page_id", F.posexplode(S.links_of(told)).alias("position", "link"))


@query("finding_keys", "SELECT page_id, trim(regexp_replace(regexp_replace(lower(url), '\\d+(\\.\\d+)?', '#', 'g'), '\\s+', ' ', 'g')) AS key FROM pages")
def finding_keys(spark, sf):
    return load(spark, sf, "pages").select("page_id", T.finding_key(F.col("url")).alias("key"))


def sentence_rows(spark, sf):
    """doc_id, section_id, section_title, section_kind, id, index, text of every document's sentences."""
    return segment.segment(segment.document_sections(spread(_docs(spark, sf))))


@query("document_outline", """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS section FROM t)
SELECT conv_id, section, CASE WHEN role = 'assistant' THEN 'Method of assistant' ELSE 'Notes of ' || role END AS title, CASE WHEN role = 'assistant' THEN 'method' ELSE 'other' END AS kind, 2 AS level, length(replace(text, '#', '')) AS chars FROM l""")
def document_outline(spark, sf):
    """Conversations as Markdown, one heading a turn, and their sections read back."""
    t = load(spark, sf, "conversations").where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit("#"), F.lit("")).alias("text"))
    title = F.when(F.col("role") == "assistant", "Method of assistant").otherwise(F.concat(F.lit("Notes of "), "role"))
    # Line breaks inside a turn become blanks, so that no line of a turn is a heading.
    part = F.concat(F.lit("## "), title, F.lit("\n"), F.translate("text", "\n", " "))
    docs = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n").alias("text"))
    x = segment.document_sections(docs, "conv_id")
    return x.select("conv_id", "section", "title", "kind", "level", F.length(F.regexp_replace("text", r"^\n|\n$", "")).alias("chars"))


@query("sentences")
def sentences(spark, sf):
    return sentence_rows(spark, sf)


@query("passages")
def passages(spark, sf):
    return sequence.chunk_sentences(sentence_rows(spark, sf))


@query("summaries")
def summaries(spark, sf):
    return summarize.summarize(sentence_rows(spark, sf))


@query("keyphrases")
def keyphrases(spark, sf):
    return summarize.keyphrases(dealt(_docs(spark, sf).select("doc_id", "text")))


@query("stemmed_terms")
def stemmed_terms(spark, sf):
    """Stems are found once per distinct word and joined back."""
    w = _docs(spark, sf).select(F.explode(T.words(F.col("text"))).alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    return w.select("word", "n", F.get(T.tokenize("word"), F.lit(0)).alias("stem"))
