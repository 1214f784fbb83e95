"""Classes of places by category, name and text. Patterns, word lists and defaults are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_pattern(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found; false for null."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return F.coalesce(out, F.lit(False))


def first_class(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The class of the first rule that holds."""
    out = F.lit(default).cast("string")
    for holds, value in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(value)).otherwise(out)
    return out


def slot_of_category(category: Column, name: Column, non_spot: list[str], stay: list[str], not_stay: list[str], by_class: list[tuple[str, list[str]]], exact: dict[str, str], lodging_names: list[str], breaks: str) -> Column:
    """The slot that a category speaks for, else null; the name can only veto.

    A non-spot category says nothing. A stay category is stay unless the name denies it. Then the
    classes in order, then the first token that equals an exact one. A lodging name outweighs any
    other slot, unless it is denied too.
    """
    cat, denied = F.trim(category), any_pattern(F.trim(name), not_stay)
    tokens = F.transform(F.split(cat, breaks), F.trim)
    table = F.create_map(*(F.lit(x) for pair in exact.items() for x in pair)) if exact else None
    short = F.get(F.filter(F.transform(tokens, lambda t: F.try_element_at(table, t)), lambda s: s.isNotNull()), F.lit(0)) if exact else F.lit(None).cast("string")
    found = F.coalesce(first_class([(any_pattern(cat, ps), slot) for slot, ps in by_class]), short)
    other = F.when(any_pattern(F.trim(name), lodging_names) & ~denied, F.lit(None)).otherwise(found)
    return F.when((cat == "") | any_pattern(cat, non_spot), F.lit(None)).when(any_pattern(cat, stay), F.when(~denied, "stay")).otherwise(F.when(cat.isNotNull(), other))


def slot_and_moods(category: Column, text: Column, stay: list[str], slots: list[tuple[str, list[str]]], moods: list[tuple[str, list[str]]], default_moods: list[str], most: int = 3) -> Column:
    """struct(slot, moods): stay by category only, other slots and the moods by all text; a default where no mood is found."""
    blob = F.concat_ws(" ", category, text)
    slot = first_class([(any_pattern(category, stay), "stay"), *((any_pattern(blob, ps), s) for s, ps in slots)], "day")
    found = F.array_compact(F.array(*(F.when(any_pattern(blob, ps), m) for m, ps in moods)))
    return F.struct(slot.alias("slot"), F.slice(F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, default_moods))), 1, most).alias("moods"))


def moods_of(tags: Column, text: Column, by_tag: dict[str, str], families: list[tuple[str, list[str]]]) -> Column:
    """Moods of tags in their order, then of pattern families in theirs, each once."""
    table = F.create_map(*(F.lit(x) for pair in by_tag.items() for x in pair))
    own = F.filter(F.transform(tags, lambda t: F.try_element_at(table, t)), lambda m: m.isNotNull())
    return F.array_distinct(F.concat(F.coalesce(own, F.array().cast("array<string>")), F.array_compact(F.array(*(F.when(any_pattern(text, ps), m) for m, ps in families)))))


def source_kind(url: Column, hosts: list[str], kind: str, other: str = "web") -> Column:
    """kind for urls of one of the hosts."""
    return F.when(any_pattern(F.lower(url), [h.replace(".", r"\.") for h in hosts]), kind).otherwise(other)


def heal_slot(stored: Column, derived: Column, overwrite: Column, stay: str = "stay") -> Column:
    """The slot to write, else null: a derived one that is missing, or differs where overwriting is on or either side is stay."""
    change = stored.isNull() | ((stored != derived) & (overwrite | (stored == stay) | (derived == stay)))
    return F.when(derived.isNotNull() & F.coalesce(change, F.lit(False)), derived)
