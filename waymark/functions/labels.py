"""Labels, templates and small lookups as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known_labels(keys: Column, labels: dict[str, str], most: int | None = None) -> Column:
    """The labels of known keys in their order, at most `most`."""
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    found = F.filter(F.transform(keys, lambda k: F.try_element_at(table, k)), lambda v: v.isNotNull())
    return F.slice(found, 1, most) if most else found


def selection_label(chosen: Column, everything: int, all_label: str) -> Column:
    """The label of a selection: all, one, two, or the first and how many more."""
    n = F.size(chosen)
    first = F.get(chosen, F.lit(0))
    return F.when((n == 0) | (n == everything), all_label).when(n == 1, first).when(n == 2, F.array_join(chosen, ", ")).otherwise(F.concat(first, F.lit(" + "), (n - 1).cast("string"), F.lit(" more")))


def longest_key(text: Column, keys: list[str]) -> Column:
    """The longest key that the text holds, the first of equals; null without one."""
    ordered = sorted(keys, key=lambda k: -len(k))
    return F.get(F.filter(F.array(*map(F.lit, ordered)), lambda k: F.contains(text, k)), F.lit(0))


def prefix_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(value, token) of the first rule whose token the text equals or begins with; null without one."""
    out = F.lit(None).cast("struct<value:string,token:string>")
    for token, value in reversed(rules):
        out = F.when(F.startswith(F.trim(text), F.lit(token)), F.struct(F.lit(value).alias("value"), F.lit(token).alias("token"))).otherwise(out)
    return out


def renamed(text: Column, names: dict[str, str]) -> Column:
    """Known names replaced, in the order given."""
    for a, b in names.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def pool_index(key: Column, text: Column, size: int) -> Column:
    """|key| modulo size, or the sum of the text's character codes where there is no key."""
    codes = F.aggregate(F.split(F.coalesce(text, F.lit("")), ""), F.lit(0).cast("long"), lambda s, c: s + F.when(c == "", 0).otherwise(F.ascii(c)))
    return F.coalesce(F.abs(key), codes) % size


def listed(json: Column, everything: str = "ALL") -> Column:
    """A saved choice as an array: a JSON string or array of strings, without the member that means all; else empty."""
    one, many = F.from_json(F.concat(F.lit('{"v":'), json, F.lit("}")), "v string")["v"], F.from_json(json, "array<string>")
    got = F.when(F.startswith(F.trim(json), F.lit("[")), many).when(F.startswith(F.trim(json), F.lit('"')), F.array(one))
    return F.filter(F.coalesce(got, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != everything))


def template(first: Column, with_it: str, without: str, **values: Column) -> Column:
    """with_it, filled in, where first is not empty; else without. Places: {0} for first, {name} for values."""

    def fill(text: str) -> Column:
        out = F.lit(text)
        for name, value in {"0": first, **values}.items():
            out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
        return out

    return F.when(F.length(first) > 0, fill(with_it)).otherwise(fill(without))


def said_or_made(summary: Column, category: Column, moods: Column, listed: str, both: str, kind: str, feel: str, neither: str) -> Column:
    """The trimmed summary, unless it is blank or nothing but listed words (a pattern); else a sentence of category and moods.

    Sentences have {category} and {moods}, joined by a middle dot; `both` needs the two, `kind` the
    category, `feel` the moods.
    """
    raw = F.trim(summary)
    joined, named = F.array_join(moods, " · "), F.nullif(F.trim(category), F.lit(""))
    some = F.coalesce(F.size(moods) > 0, F.lit(False))
    fill = lambda text: F.replace(F.replace(F.lit(text), F.lit("{category}"), F.coalesce(named, F.lit(""))), F.lit("{moods}"), F.coalesce(joined, F.lit("")))
    made = F.when(named.isNotNull() & some, fill(both)).when(named.isNotNull(), fill(kind)).when(some, fill(feel)).otherwise(neither)
    return F.when((raw != "") & ~raw.rlike(listed), raw).otherwise(made)


def shown_summary(summary: Column, name: Column, tag_words: list[str], empty_words: list[str], made: Column) -> Column:
    """The trimmed summary, or `made` where it says nothing: short, the name, Latin words alone, an empty phrase, or a tag word anywhere."""
    raw = F.coalesce(F.trim(summary), F.lit(""))
    bad = (F.length(raw) < 5) | (F.lower(raw) == F.lower(F.coalesce(F.trim(name), F.lit("")))) | raw.rlike(r"^[a-zA-Z_\s,]+$") | raw.isin(empty_words)
    for word in tag_words:
        bad = bad | F.contains(raw, F.lit(word))
    return F.when(bad, made).otherwise(raw)
