"""Scalar rules of ranking, quoting, formatting and identity as column expressions; no Python on any path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import strip_citations

#: 32-bit FNV-1a. Fixed values.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
CONNECTIVES = "however|moreover|furthermore|thus|hence|therefore|also|finally|in addition|in particular|as a result"


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def rescale(c: Column, low: float, high: float) -> Column:
    """A cosine between low and high as 0..1."""
    return clamp01((c - low) / (high - low))


def relevance(logit: Column) -> Column:
    """A re-ranker's logit as 0..1."""
    return 1 / (1 + F.exp(-(logit + 3) / 2))


def squash(c: Column) -> Column:
    return 1 - F.exp(-c)


def softmax(cols: list[Column], temperature: float) -> list[Column]:
    top = F.greatest(*cols)
    e = [F.exp((c - top) / temperature) for c in cols]
    return [x / sum(e[1:], e[0]) for x in e]


def publication_time(c: Column) -> Column:
    """The date of "2020-05-17", "2020-05" (the 15th) or "2020" (1 July); null for anything else."""
    day = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1)
    month = F.regexp_extract(c, r"^(\d{4}-\d{2})$", 1)
    year = F.regexp_extract(c, r"^(\d{4})$", 1)
    return F.when(day != "", F.try_to_date(day)).when(month != "", F.try_to_date(F.concat(month, F.lit("-15")))).when(year != "", F.try_to_date(F.concat(year, F.lit("-07-01"))))


def recency(published: Column, now: Column, half_life: float = 3.0) -> Column:
    """Half after three years of 365.25 days; 1 for the future, 0 for an unknown date."""
    age = F.greatest(F.lit(0.0), F.datediff(now, published) / 365.25)
    return F.when(published.isNull(), 0.0).otherwise(F.pow(F.lit(0.5), age / half_life))


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(words / 200 + 0.5)).cast("long")


def parse_value(c: Column) -> Column:
    """Magnitude and unit of a displayed value such as "+4.1%" or "1,200 ms"."""
    number = F.regexp_replace(F.regexp_extract(c, r"([+\-−]?\d[\d,]*(?:\.\d+)?)", 1), "[,+]", "")
    unit = F.trim(F.regexp_extract(c, r"[+\-−]?\d[\d,]*(?:\.\d+)?\s*(.*)$", 1))
    return F.struct(F.abs(F.regexp_replace(number, "−", "-").try_cast("double")).alias("magnitude"), unit.alias("unit"))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the code points, in base 36."""
    points = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    h = F.aggregate(points, F.lit(FNV_BASIS).cast("long"), lambda acc, x: F.pmod(acc.bitwiseXOR(x) * FNV_PRIME, F.lit(1 << 32)))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def dataset_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def identity_keys(arxiv: Column, doi: Column, title: Column) -> Column:
    """What a work is known by: its arXiv id without version, its DOI, and a title of three words and 15 letters or more."""
    plain = F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))
    told = (F.size(F.split(plain, " ")) >= 3) & (F.length(F.replace(plain, F.lit(" "), F.lit(""))) >= 15)
    bare = F.regexp_replace(arxiv, r"v\d+$", "")
    return F.array_compact(F.array(F.concat(F.lit("arxiv:"), bare), F.concat(F.lit("doi:"), F.lower(doi)), F.when(told, F.concat(F.lit("title:"), plain))))


def clean_quote(c: Column) -> Column:
    """Without citations, pointers to figures, and the connectives it opens with, however many."""
    c = F.regexp_replace(strip_citations(c), r"(?i)\s*\((?:see\s+)?(?:fig(?:ure|\.)?|tab(?:le|\.)?|sec(?:tion|\.)?)\s*[^)]*\)", "")
    c = F.regexp_replace(c, rf"(?i)^(?:(?:{CONNECTIVES})\b[,\s]*)+", "")
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def math_symbols(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[=<>±×÷≤≥≈∑∏∫√∂∞∈∀∃^_\\]"))


def own_claim(c: Column) -> Column:
    """A sentence in which the authors say what they did or found."""
    return c.rlike(r"(?i)\b(?:we|our (?:method|model|approach|results?|experiments?))\b")


def clutter(c: Column) -> Column:
    """0.3 for each of: more than one symbol of mathematics, more than two brackets, more than a fifth digits."""
    digits = F.regexp_count(c, F.lit(r"\d")) > F.length(c) * 0.2
    return 0.3 * ((math_symbols(c) > 1).cast("int") + (F.regexp_count(c, F.lit(r"[(\[]")) > 2).cast("int") + digits.cast("int"))


def first_sentence(c: Column) -> Column:
    """Up to the first full stop, exclamation or question mark before a blank or the end; all where there is none."""
    found = F.regexp_extract(c, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    return F.when(found != "", found).otherwise(c)


def clean_meta(c: Column) -> Column:
    """Without tags, entities and LaTeX commands, blanks squeezed."""
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for k, v in ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    c = F.regexp_replace(F.regexp_replace(c, r"\\[a-zA-Z]+\s*\{([^{}]*)\}", "$1"), r"\\[a-zA-Z]+|[${}]", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def valid_abstract(c: Column) -> Column:
    """Twenty words or more, and not a list of names: fewer commas than a fifth of its words."""
    n = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return F.coalesce((n >= 20) & (F.regexp_count(c, F.lit(",")) * 5 < n), F.lit(False))


def join_names(names: Column, most: int = 2) -> Column:
    """"A", "A and B", "A, B and 3 more"."""
    n = F.size(names)
    short = F.when(n == 0, "").when(n == 1, F.get(names, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.get(names, n - 1)))
    return F.when(n <= most, short).otherwise(F.concat(F.array_join(F.slice(names, 1, most), ", "), F.lit(" and "), (n - most).cast("string"), F.lit(" more")))


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, noun).otherwise(f"{noun}s"))


def short_quote(c: Column, most: int = 16) -> Column:
    """The first words of a text, with an ellipsis where more follow."""
    w = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    return F.when(F.size(w) <= most, F.array_join(w, " ")).otherwise(F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit("…")))


def explain(similar: Column, recent: Column, cited: Column, year: Column) -> Column:
    """The two strongest reasons of a candidate and its year. Ties in the order of the reasons."""
    r = F.array(*[F.struct((-v).alias("v"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, (v, t) in enumerate([(similar, "close to the topic"), (recent, "recent"), (cited, "often cited")])])
    top = F.slice(F.filter(F.array_sort(r), lambda x: x["v"] < 0), 1, 2)
    return F.concat_ws(", ", F.array_join(F.transform(top, lambda x: x["t"]), ", "), year.cast("string"))


def around_span(c: Column, start: Column, length: Column) -> Column:
    """before, span and after of a span given by its 0-based start."""
    return F.struct(F.substring(c, F.lit(1), start).alias("before"), F.substring(c, start + 1, length).alias("span"), F.substr(c, start + length + 1).alias("after"))


def align_span(answer: Column, context: Column) -> Column:
    """0-based start of the answer in its context: as it stands, else blind to white space, else to case too; -1 where it
    is not there."""
    chars = F.split(context, "")
    at = F.filter(F.transform(chars, lambda x, i: F.when(~x.rlike(r"^\s?$"), i)), lambda i: i.isNotNull())
    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    exact, loose, blind = F.instr(context, answer), F.instr(bare(context), bare(answer)), F.instr(F.lower(bare(context)), F.lower(bare(answer)))
    return F.when(exact > 0, exact - 1).when(loose > 0, F.get(at, loose - 1)).when(blind > 0, F.get(at, blind - 1)).otherwise(-1)


def nice_step(low: Column, high: Column, ticks: int) -> Column:
    """The step of 1, 2 or 5 times a power of ten that gives about so many ticks."""
    raw = (high - low) / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    share = raw / power
    return power * F.when(share <= 1, 1).when(share <= 2, 2).when(share <= 5, 5).otherwise(10)


def search_terms(c: Column, most: int = 12) -> Column:
    """A query as plain words: operators, quotes and field names out, at most so many words."""
    c = F.regexp_replace(F.lower(c), r"\b[a-z]+:|\b(?:and|or|not|andnot)\b|[^\p{L}\p{N}\s.-]", " ")
    w = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    return F.array_join(F.slice(w, 1, most), " ")


def links_of(c: Column) -> Column:
    """The distinct links of a text in order, without the punctuation behind them."""
    found = F.regexp_extract_all(c, F.lit(r"""https?://[^\s"'<>]+"""), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+$", "")))
