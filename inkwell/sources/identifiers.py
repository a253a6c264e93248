"""Recognisers of document identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Archives of identifiers before April 2007, hosts and path kinds that carry identifiers. Fixed values.
ARCHIVES = (
    "acc-phys adap-org alg-geom ao-sci astro-ph atom-ph bayes-an chao-dyn chem-ph cmp-lg comp-gas cond-mat cs dg-ga funct-an gr-qc hep-ex "
    "hep-lat hep-ph hep-th math math-ph mtrl-th nlin nucl-ex nucl-th patt-sol physics plasm-ph q-alg q-bio quant-ph solv-int supr-con"
).split()
HOSTS = ("arxiv.org", "www.arxiv.org", "export.arxiv.org", "browse.arxiv.org", "ar5iv.org", "ar5iv.labs.arxiv.org", "alphaxiv.org", "www.alphaxiv.org")
KINDS = ("abs", "pdf", "html", "format", "ps", "src", "overview")


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def trim_punctuation(c: Column) -> Column:
    """Without sentence punctuation at the end; a closing bracket stays where it is balanced."""
    bare = F.regexp_replace(c, r"[.,;:'\"\]}>]+$", "")
    more = F.regexp_count(bare, F.lit(r"\)")) > F.regexp_count(bare, F.lit(r"\("))
    return F.when(more & bare.endswith(")"), F.regexp_replace(bare, r"[.,;:'\"\]}>)]+$", "")).otherwise(bare)


def arxiv_id(c: Column) -> Column:
    """"id" or "id version" of an identifier, null where it is none: YYMM.number from April 2007, with five digits from
    2015; archive/YYMMNNN until March 2007, its subject class dropped. Months and eras are part of the patterns, so
    the text is looked at a few times only."""
    new = r"(?i)^(?:arxiv\s*:\s*)?((?:0704|070[5-9]|071[0-2]|0[89](?:0[1-9]|1[0-2])|1[0-4](?:0[1-9]|1[0-2]))\.\d{4}|(?:1[5-9]|[2-9]\d)(?:0[1-9]|1[0-2])\.\d{5})(v\d+)?$"
    old = r"(?i)^(?:arxiv\s*:\s*)?(" + "|".join(ARCHIVES) + r")(?:\.[a-z]{2})?/((?:9[1-9]|0[0-7])(?:0[1-9]|1[0-2])\d{3})(v\d+)?$"
    t = F.trim(c)
    return F.when(t.rlike(new), F.lower(F.trim(F.regexp_replace(t, new, "$1 $2")))).when(t.rlike(old), F.lower(F.trim(F.regexp_replace(t, old, "$1/$2 $3"))))


def id_of(ref: Column) -> Column:
    return F.substring_index(ref, " ", 1)


def version_of(ref: Column) -> Column:
    return _or_null(F.regexp_extract(ref, r" (v\d+)$", 1))


def url_part(c: Column, part: str) -> Column:
    return F.try_parse_url(c, F.lit(part))


def arxiv_id_from_url(c: Column) -> Column:
    host, path = F.lower(url_part(c, "HOST")), F.coalesce(F.try_url_decode(url_part(c, "PATH")), F.lit(""))
    kind = F.regexp_extract(path, "^/([^/]+)/", 1)
    rest = F.regexp_replace(trim_punctuation(F.regexp_extract(path, "^/[^/]+/(.+)$", 1)), r"(?i)\.pdf$", "")
    paper = host.isin("huggingface.co", "www.huggingface.co") & (kind == "papers")
    return F.when((host.isin(*HOSTS) & kind.isin(*KINDS)) | paper, arxiv_id(rest))


def doi(c: Column) -> Column:
    """A DOI in lower case without URL prefix and trailing punctuation; null where there is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/", ""), r"(?i)^doi\s*:\s*", "")
    out = F.lower(trim_punctuation(F.trim(F.coalesce(F.try_url_decode(bare), bare))))
    return F.when(out.rlike(r"^10\.\d{4,9}/\S+$"), out)


def arxiv_id_from_doi(c: Column) -> Column:
    return arxiv_id(_or_null(F.regexp_extract(F.lower(F.trim(c)), r"^10\.48550/arxiv\.(.+)$", 1)))


def parse_inputs(rows: DataFrame, col: str) -> DataFrame:
    """rows with kind, arxiv, version, doi, url, query of what a user typed: kind is arxiv, doi, pdf-url, url or topic.
    Order: absolute URL, arXiv prefix, DOI, bare arXiv id, URL without scheme, topic. Steps are columns of their own,
    so no expression is repeated inside another."""
    own = rows.columns
    t = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(F.col(col), F.lit(""))), "^[<\"'“‘`]+", ""), "[>\"'”’`]+$", ""))
    x = rows.withColumn("_t", t)
    x = x.withColumn("_arx", arxiv_id(trim_punctuation(F.regexp_replace("_t", r"(?i)\s*\[[a-z-]+(?:\.[a-z-]+)?\]$", ""))))
    x = x.withColumn("_doi", F.when(F.col("_t").rlike(r"(?i)^doi\s*:|^10\.\d{4,9}/"), doi(F.col("_t"))))
    bare = F.col("_t").rlike(r"(?i)^(?:www\.[^\s/]+|[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?::\d+)?/\S*)$")
    x = x.withColumn("_url", F.when(F.col("_t").rlike(r"(?i)^https?://[^\s/]+"), F.col("_t")).when(F.col("_arx").isNull() & F.col("_doi").isNull() & bare, F.concat(F.lit("https://"), "_t")))
    x = x.withColumns({"_host": F.lower(url_part(F.col("_url"), "HOST")), "_path": F.coalesce(url_part(F.col("_url"), "PATH"), F.lit(""))})
    embedded = _or_null(F.regexp_extract("_path", r"(?i)/doi/(?:abs/|full/|pdf/|epdf/|book/)?(10\.\d{4,9}/.+)$", 1))
    x = x.withColumn("_from", F.when(F.col("_host").isin("doi.org", "dx.doi.org"), F.substr("_path", F.lit(2))).otherwise(embedded))
    x = x.withColumn("_any", F.when(F.col("_url").isNotNull(), doi(F.col("_from"))).otherwise(F.col("_doi")))
    x = x.withColumn("_by_doi", arxiv_id_from_doi(F.col("_any"))).withColumn("_by_url", arxiv_id_from_url(F.col("_url")))
    x = x.withColumn("_ref", F.when(F.col("_url").isNotNull(), F.coalesce("_by_url", "_by_doi")).otherwise(F.coalesce("_by_doi", "_arx")))
    asked = F.coalesce(url_part(F.col("_url"), "QUERY").contains("id="), F.lit(False))
    pdf = F.col("_path").rlike(r"(?i)\.pdf$") | (F.col("_host").endswith("openreview.net") & (F.col("_path") == "/pdf") & asked)
    kind = F.when(F.col("_ref").isNotNull(), "arxiv").when(F.col("_any").isNotNull(), "doi").when(F.col("_url").isNotNull() & pdf, "pdf-url").when(F.col("_url").isNotNull(), "url").otherwise("topic")
    x = x.withColumn("_kind", kind)
    query = F.when(F.col("_kind") == "topic", F.regexp_replace("_t", r"\s+", " "))
    return x.select(*own, F.col("_kind").alias("kind"), id_of(F.col("_ref")).alias("arxiv"), version_of(F.col("_ref")).alias("version"), F.col("_any").alias("doi"), F.col("_url").alias("url"), query.alias("query"))


def split_batches(rows: DataFrame, id_col: str, col: str) -> DataFrame:
    """id_col, part: the distinct parts of a list by commas, blanks or semicolons if every part is an identifier; else
    the text alone."""
    parts = F.array_distinct(F.filter(F.split(F.trim(F.col(col)), r"[\s,;]+"), lambda p: p != ""))
    x = parse_inputs(rows.select(id_col, F.trim(F.col(col)).alias("_whole"), F.explode_outer(parts).alias("part")), "part")
    good = x.groupBy(id_col).agg(F.min(F.col("kind") != "topic").alias("_good"), F.max("_whole").alias("_whole"), F.collect_list("part").alias("_parts"))
    return good.select(id_col, F.explode(F.when(F.col("_good"), F.col("_parts")).otherwise(F.array("_whole"))).alias("part"))


def record_id(kind: Column, arxiv: Column, doi_: Column, url: Column) -> Column:
    """arxiv:, doi: or url:hash key of a record."""
    return F.when(kind == "arxiv", F.concat(F.lit("arxiv:"), arxiv)).when(kind == "doi", F.concat(F.lit("doi:"), doi_)).otherwise(F.concat(F.lit("url:"), F.substring(F.sha2(url, 256), 1, 12)))


def person_name(c: Column) -> Column:
    """"Family, Given" as "Given Family", if there is one comma."""
    parts = F.split(c, ",")
    return F.when(F.size(parts) == 2, F.trim(F.concat_ws(" ", F.trim(parts[1]), F.trim(parts[0])))).otherwise(F.trim(F.regexp_replace(c, r"\s+", " ")))
