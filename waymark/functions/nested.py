"""Values inside JSON texts whose shape isn't known in advance."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def first_under(node: object, key: str) -> tuple[str, object] | None:
    """(path, value) of the first value under the key, depth first in the order of the text.

    A node's own key comes before anything inside its other members; a null counts as not found,
    so that the search goes on beside the node that holds it. No recursion: depth has no limit.
    """
    open_: list[tuple[str, object]] = [("$", node)]
    while open_:
        path, here = open_.pop()
        if isinstance(here, dict):
            if key in here:
                if here[key] is not None:
                    return f"{path}.{key}", here[key]
                continue
            below = [(f"{path}.{name}", value) for name, value in here.items()]
        elif isinstance(here, list):
            below = [(f"{path}[{k}]", value) for k, value in enumerate(here)]
        else:
            continue
        open_ += reversed(below)
    return None


def find_key(text: Column, key: str) -> Column:
    """struct(path, value): where the key first stands in a JSON text, and its value as JSON; nulls if it doesn't, or the text is no JSON.

    JSON's order of members decides, which VARIANT doesn't keep; texts are parsed in Arrow batches.
    """

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            rows = []
            for raw in series:
                try:
                    found = first_under(json.loads(raw), key) if raw else None
                except (ValueError, RecursionError):
                    found = None
                rows.append((found[0], json.dumps(found[1], ensure_ascii=False)) if found else (None, None))
            yield pd.DataFrame(rows, columns=["path", "value"])

    return F.pandas_udf(run, "path string, value string")(text)


def items_at(text: Column, path: str, item: str) -> Column:
    """struct(items, malformed): the objects at a path of a JSON text as an array of the struct type `item`.

    A list gives its objects, a single object an array of it, anything else (a blank string, nothing)
    an empty one. A text that is no JSON has null items and malformed true; null texts have null items.
    """
    parsed = F.try_parse_json(text)
    several, one = F.try_variant_get(parsed, path, f"array<{item}>"), F.try_variant_get(parsed, path, item)
    is_list = F.startswith(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")), F.lit("ARRAY"))
    is_object = F.startswith(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")), F.lit("OBJECT"))
    none = F.array().cast(f"array<{item}>")
    found = F.when(is_list, F.coalesce(several, none)).when(is_object, F.array(one)).otherwise(none)
    return F.struct(F.when(parsed.isNotNull(), found).alias("items"), (text.isNotNull() & parsed.isNull()).alias("malformed"))


def unescaped(text: Column) -> Column:
    """The text that an escaped piece of a JSON string stands for; a piece that isn't one keeps its words, with its escaped line breaks as such."""
    parsed = F.from_json(F.concat(F.lit('{"s": "'), text, F.lit('"}')), "s string", {"mode": "PERMISSIVE"})["s"]
    return F.coalesce(parsed, F.replace(text, F.lit("\\n"), F.lit("\n")))
