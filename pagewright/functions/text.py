"""Text and score functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities that are decoded, the ampersand last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
#: An address: atoms with dots between them, an at sign, and a domain of labels whose last has letters only.
_ATOM, _LABEL = "[A-Za-z0-9_%+-]+", "[A-Za-z0-9-]+"
EMAIL = rf"{_ATOM}(?:\.{_ATOM})*@(?:{_LABEL}\.)+[A-Za-z]{{2,}}\b"
#: Phone patterns; of the first, the last ten digits count.
PHONES = [
    r"\+?1?[-.\s]?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})",
    r"\+?[0-9]{1,4}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,4}",
    r"\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
]
#: Kinds of streets; an address is a number, words of letters and one of these, and may name town, state and
#: ZIP code after it.
STREETS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Circle|Cir|Court|Ct"
STREET = rf"(?i)[0-9]+\s+[A-Za-z\s]+(?:{STREETS})"
TOWN = r",\s*[A-Za-z\s]+,\s*[A-Z]{2}\s+[0-9]{5}"
#: Suffixes that stemming takes off, in this order.
SUFFIXES = ["ing", "ed", "s", "es", "ly", "er", "est"]


def entities(text: Column) -> Column:
    """Character references of an attribute's value, decoded."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def plain(html: Column) -> Column:
    """Text of an HTML fragment: tags and entities resolved, white space squeezed."""
    return clean_text(entities(F.regexp_replace(html, "<[^>]*>", " ")))


def clean_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x00-\x20]+", " "))


def word_count(text: Column) -> Column:
    """Words between blanks of a cleaned text."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, " ")))


def normalize_text(text: Column) -> Column:
    """Lower case, other characters than letters, digits and underscores to blanks, squeezed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def simple_stem(word: Column) -> Column:
    """The first suffix that leaves more than two letters goes; words up to three letters stay."""
    out = F.when(F.length(word) <= 3, word)
    for s in SUFFIXES:
        out = out.when(word.endswith(s) & (F.length(word) > len(s) + 2), F.substring(word, F.lit(1), F.length(word) - len(s)))
    return out.otherwise(word)


def truncate_text(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def extract_emails(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)))


def extract_phones(text: Column) -> Column:
    """Digits and plus signs of what the phone patterns find, ten characters at least."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda x: F.regexp_replace(x, "[^0-9+]", "")) for p in PHONES]
    found[0] = F.transform(found[0], lambda x: F.right(x, F.lit(10)))
    return F.array_distinct(F.filter(F.concat(*found), lambda x: F.length(x) >= 10))


def extract_addresses(text: Column) -> Column:
    """Different street addresses of a text, in any case: each street with its number alone, and once more with town, state
    and ZIP code where those follow. Null for a null text."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (STREET, STREET + TOWN)]
    return F.array_distinct(F.concat(*found))


def count_occurrences(text: Column, keyword: Column) -> Column:
    """Whole-word, non-overlapping places of a normalized keyword in a normalized text."""
    wide = F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit(" "))
    key = F.concat(F.lit(" "), F.replace(keyword, F.lit(" "), F.lit("  ")), F.lit(" "))
    return ((F.length(wide) - F.length(F.replace(wide, key, F.lit("")))) / F.length(key)).cast("bigint")


def wordcount_bucket(words: Column) -> Column:
    return F.when(words < 100, "0-99").when(words < 500, "100-499").when(words < 1000, "500-999").when(words < 2000, "1000-1999").when(words < 5000, "2000-4999").otherwise("5000+")


def clamp_0_100(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def bandwidth_adjusted_load(load_ms: Column, size: Column, mbps: float) -> Column:
    return load_ms + size * 8 / F.lit(mbps * 1e6) * 1000


def format_runtime(seconds: Column) -> Column:
    return F.format_string("%dm %ds", F.floor(seconds / 60), F.floor(F.pmod(seconds, F.lit(60))))
