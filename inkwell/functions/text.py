"""Text functions as column expressions; Arrow functions only where a rule scans sequentially or needs Unicode tables."""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: letters and digits, joined by apostrophes or hyphens.
WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
#: Shortest sentence that is kept, longest one that still counts as prose.
MIN_SENTENCE, MAX_SENTENCE = 25, 1500
#: Common function words of English; a parameter of tokenize, not a claim of completeness.
STOPWORDS = frozenset(
    "a about above after again against all also am an and any are as at be because been before being below between both but by "
    "can could did do does doing down during each etc few for from further had has have having he her here hers him his how i if "
    "in into is it its just may me might more most must my no nor not now of off on once only or other our out over own per same "
    "she should so some such than that the their them then there these they this those through to too under until up upon us very "
    "was we were what when where which while who whom why will with within without would you your".split()
)


def rounded(c: Column, digits: int) -> Column:
    """Rounds halves toward positive infinity."""
    f = 10**digits
    return F.floor(c * f + 0.5) / f


@F.pandas_udf(T.StringType())
def normalize_text(s: pd.Series) -> pd.Series:
    """NFKC, invisible characters out, white space to single blanks, trimmed."""
    invisible = dict.fromkeys([0xAD, *range(0x200B, 0x200E), 0x2060, 0xFEFF])
    return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).translate(invisible).split()))


@F.pandas_udf(T.StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """NFKD without combining marks."""
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def words(c: Column) -> Column:
    """Words of normalised text, in their own case."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0))


def terms(c: Column) -> Column:
    """Lower-cased words."""
    return F.transform(words(c), F.lower)


def fingerprint(c: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def word_count(c: Column) -> Column:
    """Blank-separated words; none in an empty text."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def looks_like_prose(c: Column) -> Column:
    """Mostly letters, few digits, four words or more, not too long."""
    seen = F.regexp_replace(c, r"\s+", "")
    n = F.length(seen)
    share = lambda p: F.regexp_count(c, F.lit(p)) / n
    wordy = F.size(F.filter(F.split(c, r"\s+"), lambda w: w.rlike(r"\p{L}{2,}"))) >= 4
    return F.coalesce((F.length(c) <= MAX_SENTENCE) & (n > 0) & (share(r"\p{L}") >= 0.55) & (share(r"\p{N}") <= 0.3) & wordy, F.lit(False))


def syllables(word: Column) -> Column:
    """Vowel groups of an English word after silent endings; at least one where there are letters."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    silent = F.regexp_replace(w, "([^laeiouy])es$|([^laeiouytd])ed$|([^laeiouy])e$", "$1$2$3")
    groups = F.regexp_count(F.regexp_replace(silent, "^y", ""), F.lit("[aeiouy]+"))
    return F.when(F.length(w) == 0, 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), groups))


def flesch(words_per_sentence: Column, syllables_per_word: Column) -> Column:
    """Reading ease. The part that does not depend on syllables is decimal where words_per_sentence is whole or decimal, so
    that it has no error of its own before rounding."""
    return F.lit(Decimal("206.835")) - F.lit(Decimal("1.015")) * words_per_sentence - 84.6 * syllables_per_word


def verdict(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The label of the first step that value reaches, steps falling."""
    out = F.when(value >= steps[0][0], steps[0][1])
    for least, label in steps[1:]:
        out = out.when(value >= least, label)
    return out.otherwise(last)


def strip_citations(c: Column) -> Column:
    """Without bracketed numbers, author-year citations and the blanks they leave."""
    c = F.regexp_replace(c, r"\s*\[\d+(?:\s*[,;–-]\s*\d+)*\]", "")
    c = F.regexp_replace(c, r"\s*\([^()]*(?:et al\.|\p{Lu}[\p{L}'’-]+),?\s+(?:19|20)\d{2}[a-z]?[^()]*\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+([.,;:])", "$1"), r"\s+", " "))


def truncate(c: Column, most: int) -> Column:
    """At most so many characters: cut at the last blank where that lies beyond 60 % of them, with an ellipsis."""
    head = F.substring(c, 1, most - 1)
    blank = F.length(head) - F.length(F.regexp_extract(head, r"[^ ]*$", 0))
    cut = F.when(blank - 1 > most * 0.6, F.substring(head, F.lit(1), blank - 1)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit("…")))


def url_core(c: Column) -> Column:
    """A URL without scheme, www. and trailing slashes or punctuation."""
    bare = F.regexp_replace(F.lower(c), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), r"[/.,;:)]+$", "")


def compact_count(c: Column) -> Column:
    """12345 as 12k, 1234 as 1.2k."""
    return F.when(c >= 10000, F.concat(F.floor(c / 1000 + 0.5).cast("string"), F.lit("k"))).when(
        c >= 1000, F.concat(F.format_string("%.1f", rounded(c / 1000, 1)), F.lit("k"))
    ).otherwise(c.cast("string"))


def finding_key(c: Column) -> Column:
    """Digits masked, lower case, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\d+(\.\d+)?", "#"), r"\s+", " "))


# Sentences.

#: Short forms whose full stop never ends a sentence: they announce what follows. All other short forms are told by what
#: follows them.
ANNOUNCING = frozenset("eg ie cf vs viz approx ca dr mr mrs ms prof fig figs eq eqs sec secs tab alg thm".split())
#: Short forms that stand inside sentences as well as at their end.
EITHER = frozenset("al etc inc ltd co corp univ dept st jr no nos vol ch app ref refs ed pp resp est max min avg".split())
OPENING, CLOSING = "\"'“‘([{", "\"'”’)]}"
_TAIL = re.compile(rf"([.!?…]+)([{re.escape(CLOSING)}]*)(\d{{0,2}})$")
_HARD = re.compile(r"\n[^\S\n]*\n|[•●▪◦‣∙]")
_ITEM = re.compile(r"(?:[-–—*]|\(?(?:\d{1,2}|[a-z]|[ivx]{1,4})[.)])\s+")


def _may_open(token: str) -> bool:
    """A sentence opens with a capital, a script without case, or a digit, behind any opening marks."""
    bare = token.lstrip(OPENING)
    return bool(bare) and bare[0].isalnum() and not bare[0].islower()


def _closes(token: str, following: str, first: bool) -> bool:
    """Whether a sentence ends after token, when following comes next; first: nothing of it stands before token."""
    tail = _TAIL.search(token)
    if not tail or not _may_open(following):
        return False
    core = token[: tail.start()].strip(OPENING + CLOSING)
    stops, closers, note = tail.groups()
    if note and not core[-1:].isalpha():
        return False
    if closers or set(stops) != {"."}:
        return True
    if first and (core.isdigit() or len(core) == 1):
        return False
    bare = core.replace(".", "").lower()
    if bare in ANNOUNCING:
        return False
    if bare in EITHER or "." in core and len(bare) <= 4 and bare.isalpha() or len(core) == 1 and core.isupper():
        return following.strip(OPENING + CLOSING + ",;:").lower() in STOPWORDS
    return True


def split_sentences(text: str | None) -> list[str]:
    """Sentences of 25 characters or more. Blank lines and bullets are hard ends; abbreviations, initials, list numbers
    and footnote marks are not."""
    out: list[str] = []
    for block in _HARD.split(text or ""):
        tokens = unicodedata.normalize("NFKC", block).split()
        start = 0
        for i in range(len(tokens)):
            if i + 1 == len(tokens) or (tokens[i][-1] in ".!?…0123456789" + CLOSING and _closes(tokens[i], tokens[i + 1], i == start)):
                line = _ITEM.sub("", " ".join(tokens[start : i + 1]), count=1) if _ITEM.match(tokens[start] + " ") else " ".join(tokens[start : i + 1])
                if len(line) >= MIN_SENTENCE:
                    out.append(line)
                start = i + 1
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences(s: pd.Series) -> pd.Series:
    return s.map(split_sentences)


# Stems: Porter's published algorithm of 1980. Its suffixes are fixed values.

_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """c and v of the letters of a word: y is a vowel behind a consonant."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c", _shape(w)))


def _short(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _swap(w: str, table: dict[str, str], least: int) -> str:
    """The longest suffix of the table is replaced where what is left of it measures more than least."""
    for k in sorted((k for k in table if w.endswith(k)), key=len, reverse=True)[:1]:
        if _measure(w[: -len(k)]) > least:
            return w[: -len(k)] + table[k]
    return w


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """Porter stem of a lower-case word; words of other letters than a-z stay."""
    w = word
    if len(w) <= 2 or not (w.isascii() and w.isalpha()):
        return w
    w = _swap(w, {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}, -1)
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for k in ("ed", "ing"):
            if w.endswith(k) and "v" in _shape(w[: -len(k)]):
                w = w[: -len(k)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2, 0), _STEP3, 0)
    ends = sorted((k for k in _STEP4 if w.endswith(k)), key=len, reverse=True)
    if ends and (root := w[: -len(ends[0])]) and _measure(root) > 1 and (ends[0] != "ion" or root[-1] in "st"):
        w = root
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


@lru_cache(1 << 17)
def _term(word: str) -> str | None:
    """The stem of a word as it stands in a text; none of a function word or a single character."""
    low = word.lower().replace("’", "'").removesuffix("'s")
    return stem(low) if len(low) > 1 and low not in STOPWORDS else None


def tokenize_text(text: str | None) -> list[str]:
    return [k for w in _WORD.findall(unicodedata.normalize("NFKC", text or "")) if (k := _term(w))]


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokenize(s: pd.Series) -> pd.Series:
    """Stemmed content words in order; each distinct word is stemmed once a worker."""
    return s.map(tokenize_text)
