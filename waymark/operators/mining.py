"""Candidates from web pages and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import strip_tags


def tag_texts(html: Column, tag: str) -> Column:
    """The texts of all elements of a tag, without inner tags; empty ones go."""
    found = F.regexp_extract_all(html, F.lit(f"(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"), 1)
    return F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), strip_tags), lambda t: t != "")


def quoted_items(text: Column, patterns: list[str], shortest: int = 2, longest: int = 12, stop: list[str] | None = None) -> Column:
    """Distinct captures of the patterns within the length limits and without stop words, in order of the patterns."""
    found = F.concat(*(F.coalesce(F.regexp_extract_all(text, F.lit(p), 1), F.array().cast("array<string>")) for p in patterns))
    trimmed = F.array_distinct(F.transform(found, F.trim))
    stopped = lambda t: F.exists(F.array(*map(F.lit, stop)), lambda s: F.contains(t, s)) if stop else F.lit(False)
    return F.filter(trimmed, lambda t: F.length(t).between(shortest, longest) & ~stopped(t))


def first_source(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Of each group the passing rows of the source with the lowest priority that has any."""
    passing = candidates.filter("passes")
    first = passing.groupBy(*by).agg(F.min("priority").alias("priority"))
    return passing.join(first, [*by, "priority"])


def search_tokens(*columns: Column) -> Column:
    """Distinct lower-cased runs of letters and digits of all columns, sorted."""
    text = F.lower(F.concat_ws(" ", *columns))
    return F.array_sort(F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")))


def title_parts(title: Column, fillers: list[str]) -> Column:
    """The parts of a title between separators, without filler words; empty ones go."""
    parts = F.split(title, r"\s*[|/·,&-]+\s*")
    clean = lambda t: F.trim(F.regexp_replace(t, "|".join(fillers), "")) if fillers else F.trim(t)
    return F.filter(F.transform(parts, clean), lambda t: t != "")


def name_gate(name: Column, stop: list[str], shortest: int = 2, longest: int = 25, most_tokens: int = 4) -> Column:
    """struct(ok, reason) of a candidate name, by ordered rules."""
    n = F.trim(name)
    rules = [
        (n.isNull() | (n == ""), "empty"),
        (n.rlike(r"[.!?…]$"), "sentence"),
        ((F.length(n) - F.length(F.translate(n, "(", ""))) != (F.length(n) - F.length(F.translate(n, ")", ""))), "brackets"),
        (n.rlike(r"[<>{}#@^~|\\]"), "symbols"),
        ((F.length(n) < shortest) | (F.length(n) > longest), "length"),
        (~n.rlike(r"\p{L}"), "letters"),
        (F.size(F.split(n, r"\s+")) > most_tokens, "tokens"),
        (F.coalesce(F.arrays_overlap(F.split(F.lower(n), r"\s+"), F.array(*map(F.lit, stop))), F.lit(False)) if stop else F.lit(False), "stopword"),
    ]
    reason = F.lit(None).cast("string")
    for holds, why in reversed(rules):
        reason = F.when(F.coalesce(holds, F.lit(False)), why).otherwise(reason)
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))
