"""Text predicates and normalisers as Column expressions; word lists are parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, which must be the same to give the same results: suffixes of administrative units,
# those that a zone word may carry as an area's name, and what separates the tokens of a place's text.
UNIT_SUFFIXES = ["구", "시", "군", "동", "읍", "면"]
AREA_SUFFIXES = ["시", "군", "구", "광역시", "특별시", "특별자치시"]
TOKEN_BREAKS = r"[\s&,·\-—~/()\[\]]+"


def quoted(word: str) -> str:
    """A word as a literal regular expression, in Java and RE2 alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", word)


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return F.coalesce(out, F.lit(False))


def contains_masked(text: Column, word: str, hosts: list[str]) -> Column:
    """Whether word occurs outside the longer host words that merely contain it."""
    for host in hosts:
        text = F.replace(text, F.lit(host), F.lit(" "))
    return F.coalesce(F.contains(text, F.lit(word)), F.lit(False))


def any_masked(text: Column, words: list[str], hosts: dict[str, list[str]]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | contains_masked(text, word, hosts.get(word, []))
    return out


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), TOKEN_BREAKS), lambda x: x != "")


def has_token(text: Column, words: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(tokens(text), F.array(*map(F.lit, words))), F.lit(False))


def has_unit_suffix(text: Column) -> Column:
    return F.coalesce(F.right(text, F.lit(1)).isin(UNIT_SUFFIXES), F.lit(False))


def area_forms(word: Column) -> Column:
    """The areas that a word names: itself, with the suffix of a city, county or district, and, unless it has a unit's suffix, with any unit's."""
    plain = [word, *(F.concat(word, F.lit(s)) for s in AREA_SUFFIXES)]
    more = [F.concat(word, F.lit(s)) for s in UNIT_SUFFIXES if s not in AREA_SUFFIXES]
    return F.when(has_unit_suffix(word), F.array(*plain)).otherwise(F.array(*plain, *more))


def area_is_keyword(area: Column, keyword: Column) -> Column:
    """Whether the area is a form of the keyword."""
    return F.coalesce(F.array_contains(area_forms(keyword), area), F.lit(False))


def area_of(area: Column, location: Column) -> Column:
    """The trimmed area, else the first unit-suffixed word of the location, else null."""
    found = F.regexp_extract(location, "([가-힣]+(?:구|시|군))", 1)
    return F.coalesce(F.nullif(F.trim(area), F.lit("")), F.nullif(found, F.lit("")))


def clean_query(query: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(query, r"[#·,/\\]", " ")))


def matches_query(text: Column, query: Column, mode: str = "any") -> Column:
    """One token must occur; of several all must, or with mode "any" at least one of two or more characters."""
    parts = F.filter(F.split(clean_query(query), r"\s+"), lambda x: x != "")
    low = F.lower(text)
    every = F.forall(parts, lambda t: F.contains(low, t))
    found = every if mode == "all" else every | ((F.size(parts) > 1) & F.exists(parts, lambda t: (F.length(t) >= 2) & F.contains(low, t)))
    return F.coalesce(found, F.lit(False))


def matches_synonyms(text: Column, query: Column, synonyms: dict[str, list[str]]) -> Column:
    """Whether the query holds a key any of whose synonyms occur in the text."""
    low, asked, out = F.lower(text), clean_query(query), F.lit(False)
    for key, words in synonyms.items():
        out = out | (F.contains(asked, F.lit(key.lower())) & contains_any(low, [w.lower() for w in words]))
    return F.coalesce(out, F.lit(False))


def looks_like_heading(name: Column, patterns: list[str]) -> Column:
    """Empty, without letters or digits, or matching a heading pattern."""
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    out = (trimmed == "") | ~trimmed.rlike(r"[0-9A-Za-z가-힣]")
    for p in patterns:
        out = out | trimmed.rlike(p)
    return out


def is_broad_label(name: Column) -> Column:
    """Three or more parts between slashes, or several joined by '&' that end in a zone word."""
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    return (trimmed == "") | (F.size(F.split(trimmed, "/")) >= 3) | trimmed.rlike("&.*&.*권$")


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def human_number(text: Column) -> Column:
    """A count such as 1.2M, 3.5K, 15만, 3.5천 or 45,120 as a long; null without a number."""
    plain = F.regexp_replace(F.upper(text), r"[,\s]", "")
    units = (("만", 10_000), ("천", 1_000), ("M", 1_000_000), ("K", 1_000))
    out = F.regexp_extract(plain, r"(\d+)", 1)
    out = F.when(out != "", out.cast("double"))
    for unit, k in reversed(units):
        number = F.regexp_extract(plain, rf"(\d+(?:\.\d+)?){unit}", 1)
        out = F.when(number != "", number.cast("double") * k).otherwise(out)
    return F.floor(F.round(out, 3)).cast("long")


def normal_name(name: Column) -> Column:
    """Lower case without blanks and punctuation."""
    return F.lower(F.regexp_replace(name, r"[\s\p{Punct}·—]+", ""))


def strip_affixes(name: Column, affixes: list[str]) -> Column:
    """Removes each generic prefix or suffix while at least two characters remain."""
    for a in affixes:
        n = len(a)
        name = F.when(F.endswith(name, F.lit(a)) & (F.length(name) >= n + 2), F.substring(name, F.lit(1), F.length(name) - n)).otherwise(name)
        name = F.when(F.startswith(name, F.lit(a)) & (F.length(name) >= n + 2), F.substring(name, F.lit(n + 1), F.length(name))).otherwise(name)
    return name


def token_aligned(shorter: Column, longer_tokens: Column) -> Column:
    """Whether shorter equals the join of the first k or last k tokens, for some k."""
    n = F.size(longer_tokens)
    head = F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(longer_tokens, F.lit(1), k), "") == shorter)
    tail = F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(longer_tokens, n - F.least(k, n) + 1, F.least(k, n)), "") == shorter)
    return F.coalesce((n > 0) & (head | tail), F.lit(False))


def trigrams(text: Column) -> Column:
    """Distinct three-character shingles of the text padded as database trigram indexes pad it."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def array_similarity(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def salvage_json(text: Column) -> Column:
    """What stands between the first { and the last }, without code fences; null without any."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def time_slots(hour: Column) -> Column:
    """The two slots of an hour of the day."""
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    return F.when(hour.between(5, 13), pair("day", "evening")).when(hour.between(14, 19), pair("evening", "night")).otherwise(pair("night", "stay"))


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:v=|youtu\.be/|shorts/|embed/)([A-Za-z0-9_-]{11})", 1), F.lit(""))
