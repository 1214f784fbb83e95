"""Gates and cleaners of names, links and prices. Word lists are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.classify import any_pattern
from waymark.functions.text import contains_any, has_token


def facility_conflict(name: Column, hosts: list[str], facilities: list[str]) -> Column:
    """A lodging word and a facility token in one name: the bar or spa of a hotel, not the hotel."""
    return contains_any(name, hosts) & has_token(name, facilities)


def lodging_price(price: Column, per_night: str, not_lodging: str, both: list[str]) -> Column:
    """Whether a price is one of lodging: per night, or (unless it is by hour, head or course) with all words of both."""
    p = F.lower(price)
    nightly, paired = p.rlike(per_night), F.lit(True)
    for word in both:
        paired = paired & F.contains(p, F.lit(word))
    return F.coalesce(F.when(p.rlike(not_lodging), nightly).otherwise(nightly | paired), F.lit(False))


def header_like(name: Column, indicators: list[str], longest: int = 24) -> Column:
    """A name that is too long or holds an indicator word; an empty one is not."""
    return F.coalesce((F.length(name) > longest) | contains_any(name, indicators), F.lit(False))


def dummy_name(name: Column, media: list[str], guides: list[str], patterns: list[str], starts: list[str]) -> Column:
    """No single place: empty, a media or guide word, two slashes, a broad pattern or a known start."""
    n = F.trim(F.coalesce(name, F.lit("")))
    known = F.lit(False)
    for s in starts:
        known = known | F.startswith(n, F.lit(s))
    slashes = F.length(n) - F.length(F.translate(n, "/", ""))
    return (n == "") | contains_any(n, media) | contains_any(n, guides) | (slashes >= 2) | any_pattern(n, patterns) | known


def foreign_content(title: Column, description: Column, words: list[str], scripts: str, label: str, head: int = 300) -> Column:
    """The first word in the title or the first `head` characters of the description, else label for a foreign script in the title, else empty."""
    blob = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(description, F.lit("")), 1, head)))
    hit = F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(blob, F.lower(w))), F.lit(0))
    return F.coalesce(hit, F.when(title.rlike(scripts), label), F.lit(""))


def short_form(url: Column, text: Column, path: str, hashtags: list[str]) -> Column:
    return F.coalesce(F.contains(url, F.lit(path)), F.lit(False)) | contains_any(F.lower(text), hashtags)


def valid_url(url: Column, shortest: int = 10) -> Column:
    u = F.trim(url)
    return F.coalesce((F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://"))) & (F.length(u) >= shortest), F.lit(False))


def without_words(text: Column, words: list[str]) -> Column:
    """Each word gives way to a blank; blanks are squeezed."""
    for w in words:
        text = F.replace(text, F.lit(w), F.lit(" "))
    return squeezed(text)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_candidate(text: Column, ornaments: str, edges: str) -> Column:
    """Without ornaments, squeezed, without the characters of `edges` at both ends; null is empty."""
    return F.trim(squeezed(F.regexp_replace(F.coalesce(text, F.lit("")), ornaments, " ")), F.lit(edges))


def clean_name(name: Column, tails: list[str], shortest: int = 2) -> Column:
    """Without brackets and what follows a tail word; the name as it was if too little is left."""
    clean = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\([^)]*\)|\[[^\]]*\]", ""))
    if tails:
        clean = F.trim(F.regexp_replace(clean, rf"(?i)\s+(?:{'|'.join(tails)}).*$", ""))
    clean = squeezed(F.regexp_replace(clean, r"\s+—\s+.*$", ""))
    return F.when(F.length(clean) >= shortest, clean).otherwise(F.coalesce(name, F.lit("")))


def fresh_links(links: Column, views: Column, title: Column, least: int, stale: list[str], key: str) -> Column:
    """The map of links without `key` where its clip has too few views or a stale word in its title."""
    old = (F.coalesce(views, F.lit(0)) < least) | contains_any(F.lower(title), stale)
    return F.map_filter(links, lambda k, _: (k != key) | ~old)


def checked(rules: list[tuple[Column, str]]) -> Column:
    """struct(ok, error): all broken rules' messages, in order, joined by '; '."""
    errors = F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), message) for broken, message in rules)))
    return F.struct((F.size(errors) == 0).alias("ok"), F.array_join(errors, "; ").alias("error"))
