"""Bibliographic records: JSON of four services to one schema, merged by rank of their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.sources import identifiers as ids

DATACITE = (
    "data struct<id:string,attributes:struct<doi:string,identifiers:array<struct<identifier:string,identifierType:string>>,"
    "creators:array<struct<name:string,givenName:string,familyName:string>>,titles:array<struct<title:string>>,publicationYear:int,"
    "subjects:array<struct<subject:string,subjectScheme:string>>,dates:array<struct<date:string,dateType:string>>,"
    "descriptions:array<struct<description:string,descriptionType:string>>,url:string,citationCount:int>>"
)
OPENALEX = (
    "id string, doi string, title string, publication_year int, publication_date string, cited_by_count int,"
    "primary_location struct<landing_page_url:string,pdf_url:string,source:struct<display_name:string>>,"
    "authorships array<struct<author:struct<display_name:string>,raw_author_name:string>>, abstract_inverted_index map<string,array<int>>"
)
CROSSREF = (
    "message struct<title:array<string>,author:array<struct<given:string,family:string>>,published:struct<`date-parts`:array<array<int>>>,"
    "issued:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,`published-print`:struct<`date-parts`:array<array<int>>>,"
    "created:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>,event:struct<name:string>,DOI:string,URL:string,"
    "`is-referenced-by-count`:int,abstract:string>"
)
SCHOLAR = "externalIds struct<ArXiv:string,DOI:string>, citationCount int, openAccessPdf struct<url:string>"
FIELDS = ("title", "authors", "abstract", "published", "year", "venue", "citations", "arxiv", "doi", "url")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def inverted_abstract(index: Column) -> Column:
    """The text of a map word -> positions; negative positions are ignored."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.filter(e["value"], lambda p: p >= 0), lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.when(F.size(index) > 0, F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "))


def strip_markup(c: Column) -> Column:
    """Without headings, citation superscripts and tags of journal XML."""
    c = F.regexp_replace(c, r"(?is)<(?:jats:)?title>.*?</(?:jats:)?title>", " ")
    c = F.regexp_replace(c, r"(?is)<(?:jats:)?(?:sup|xref)[^>]*>.*?</(?:jats:)?(?:sup|xref)>", "")
    return squeeze(F.regexp_replace(c, r"<[^>]+>", " "))


def date_of(parts: Column) -> Column:
    """ISO date of year, month and day parts as far as they go."""
    p = parts.getItem(0)
    two = lambda i: F.lpad(F.get(p, F.lit(i)).cast("string"), 2, "0")
    return F.concat_ws("-", F.get(p, F.lit(0)).cast("string"), two(1), two(2))


def _meta(**cols: Column) -> list[Column]:
    kinds = {"authors": "array<string>", "year": "int", "citations": "int"}
    return [cols.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in FIELDS]


def map_datacite(raw: DataFrame, key: str, json: str) -> DataFrame:
    a = F.from_json(json, DATACITE)["data"]["attributes"]
    x = raw.select(key, a.alias("a"))
    kind = lambda t: F.array_min(F.transform(F.filter("a.dates", lambda d: F.lower(d["dateType"]) == t), lambda d: d["date"]))
    published = F.coalesce(kind("submitted"), kind("available"), kind("issued"))
    about = F.filter("a.descriptions", lambda d: F.lower(d["descriptionType"]) == "abstract")
    name = lambda c: F.when(c["givenName"].isNotNull() & c["familyName"].isNotNull(), F.concat_ws(" ", c["givenName"], c["familyName"])).otherwise(ids.person_name(c["name"]))
    arx = ids.arxiv_id_from_doi(F.col("a.doi"))
    return x.select(key, *_meta(title=squeeze(F.col("a.titles")[0]["title"]), authors=F.transform("a.creators", name), abstract=squeeze(F.get(about, F.lit(0))["description"]), published=F.substring(published, 1, 10), year=F.coalesce(F.col("a.publicationYear"), F.substring(published, 1, 4).cast("int")), citations=F.col("a.citationCount"), arxiv=ids.id_of(arx), doi=ids.doi(F.col("a.doi")), url=F.col("a.url")))


def map_openalex(raw: DataFrame, key: str, json: str) -> DataFrame:
    x = raw.select(key, F.from_json(json, OPENALEX).alias("w"))
    at = F.col("w.primary_location")
    arx = F.coalesce(ids.arxiv_id_from_url(at["landing_page_url"]), ids.arxiv_id_from_doi(ids.doi(F.col("w.doi"))))
    names = F.transform("w.authorships", lambda a: ids.person_name(F.coalesce(a["author"]["display_name"], a["raw_author_name"])))
    # A preprint cannot be dated before the month of its identifier.
    floor = F.when(arx.rlike(r"^\d{4}\."), F.concat(F.lit("20"), F.substring(arx, 1, 2), F.lit("-"), F.substring(arx, 3, 2)))
    return x.select(key, *_meta(title=squeeze(F.col("w.title")), authors=names, abstract=inverted_abstract(F.col("w.abstract_inverted_index")), published=F.greatest(F.col("w.publication_date"), floor), year=F.col("w.publication_year"), venue=at["source"]["display_name"], citations=F.col("w.cited_by_count"), arxiv=ids.id_of(arx), doi=ids.doi(F.col("w.doi")), url=F.coalesce(at["pdf_url"], at["landing_page_url"])))


def map_crossref(raw: DataFrame, key: str, json: str) -> DataFrame:
    x = raw.select(key, F.from_json(json, CROSSREF)["message"].alias("m"))
    when = F.coalesce(*[F.when(F.col(f"m.`{c}`.`date-parts`")[0][0].isNotNull(), date_of(F.col(f"m.`{c}`.`date-parts`"))) for c in ("published", "issued", "published-online", "published-print", "created")])
    names = F.transform("m.author", lambda a: F.concat_ws(" ", a["given"], a["family"]))
    venue = F.coalesce(F.get("m.container-title", F.lit(0)), F.col("m.event.name"))
    return x.select(key, *_meta(title=squeeze(strip_markup(F.get("m.title", F.lit(0)))), authors=names, abstract=strip_markup(F.col("m.abstract")), published=when, year=F.substring(when, 1, 4).cast("int"), venue=venue, citations=F.col("m.is-referenced-by-count"), doi=ids.doi(F.col("m.DOI")), url=F.col("m.URL")))


def map_scholar(raw: DataFrame, key: str, json: str) -> DataFrame:
    x = raw.select(key, F.from_json(json, SCHOLAR).alias("s"))
    pdf = F.when(F.col("s.openAccessPdf.url").rlike(r"(?i)\.pdf(\?|$)"), F.col("s.openAccessPdf.url"))
    return x.select(key, *_meta(citations=F.col("s.citationCount"), arxiv=ids.id_of(ids.arxiv_id(F.col("s.externalIds.ArXiv"))), doi=ids.doi(F.col("s.externalIds.DOI")), url=pdf))


def merge(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Full outer join: the primary's field wins where it has one; the venue "arXiv" loses to any other."""
    b = secondary.select(key, *[F.col(c).alias(f"b_{c}") for c in FIELDS])
    out = []
    for c in FIELDS:
        a = F.when(F.size(c) > 0, F.col(c)) if c == "authors" else F.when(F.lower(c).startswith("arxiv") & F.col("b_venue").isNotNull(), None).otherwise(F.col(c)) if c == "venue" else F.col(c)
        out.append(F.coalesce(a, F.col(f"b_{c}"), *([F.col(c)] if c == "venue" else [])).alias(c))
    return primary.join(b, key, "full").select(key, *out)


def resolve(crossref: DataFrame, openalex: DataFrame, scholar: DataFrame, key: str) -> DataFrame:
    """Crossref's fields, filled by OpenAlex, then by Semantic Scholar; citations in the order OpenAlex, Scholar, Crossref."""
    cites = openalex.select(key, F.col("citations").alias("c1")).join(scholar.select(key, F.col("citations").alias("c2")), key, "full")
    out = merge(merge(crossref, openalex, key), scholar, key).join(cites, key, "left")
    return out.withColumn("citations", F.coalesce("c1", "c2", "citations")).drop("c1", "c2")


def resolution(arxiv_typed: Column, arxiv_of_doi: Column, arxiv_linked: Column, arxiv_same_title: Column) -> Column:
    """The arXiv id of a work and where it came from: what was typed, else what the DOI says, else a link of a record, else
    the preprint of the same title."""
    told = [(arxiv_typed, "typed"), (arxiv_of_doi, "doi"), (arxiv_linked, "link"), (arxiv_same_title, "title")]
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("arxiv"), F.lit(w).alias("via"))) for c, w in told])


def version_link(arxiv: Column, version: Column) -> Column:
    """The link of a preprint's file, pinned to a version where one is known."""
    return F.concat(F.lit("https://arxiv.org/pdf/"), arxiv, F.coalesce(F.concat(F.lit("v"), version.cast("string")), F.lit("")))


def title_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")


def match_titles(papers: DataFrame, preprints: DataFrame) -> DataFrame:
    """papers with the arXiv id of the preprint of the same title, ignoring case and punctuation; of several the least id."""
    p = preprints.select(F.trim(title_key(F.col("title"))).alias("k"), F.col("arxiv").alias("found")).where("k <> ''").groupBy("k").agg(F.min("found").alias("found"))
    return papers.withColumn("k", F.trim(title_key(F.col("title")))).join(p, "k", "left").withColumn("arxiv", F.coalesce("arxiv", "found")).drop("k", "found")
