"""Markdown guides as rows of sections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def front_matter_tags(content: Column) -> Column:
    """The tags of a front matter, as an inline list or dashes."""
    head = F.regexp_extract(content, r"(?s)\A---\s*\n(.*?)\n---", 1)
    inline = F.split(F.regexp_extract(head, r"(?m)^tags:\s*\[(.*?)\]", 1), ",")
    dashed = F.regexp_extract_all(F.regexp_extract(head, r"(?m)^tags:[ \t]*\n((?:[ \t]*-[^\n]*\n?)+)", 1), F.lit(r"-\s*([^\n]+)"), 1)
    clean = lambda c: F.filter(F.transform(c, lambda t: F.trim(F.regexp_replace(t, "[\"']", ""))), lambda t: t != "")
    return F.concat(clean(inline), clean(dashed))


def split_sections(content: str | None, skip: list[str]) -> list[tuple[str, int, str]]:
    """(title, level, body) of sections that describe one thing.

    A section with two or more children at the next level is a container and gives its children
    only; a skipped title takes the whole subtree with it.
    """
    found: list[tuple[str, int, list[str]]] = []
    for line in (content or "").split("\n"):
        if m := HEADING.match(line):
            found.append((m[2], len(m[1]), []))
        elif found:
            found[-1][2].append(line)
    out, dropped = [], 7
    for k, (title, level, body) in enumerate(found):
        if level > dropped:
            continue
        dropped = 7
        if any(w in title for w in skip):
            dropped = level
            continue
        below = []
        for _, other, _ in found[k + 1 :]:
            if other <= level:
                break
            below.append(other)
        if below and below.count(min(below)) >= 2:
            continue
        out.append((title, level, "\n".join(body).strip()))
    return out


def sections(documents: DataFrame, skip: list[str]) -> DataFrame:
    """path, n (from 0), title, level, body of every section."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, n, *s) for p, c in zip(batch["path"], batch["content"], strict=True) for n, s in enumerate(split_sections(c, skip))]
            yield pd.DataFrame(rows, columns=["path", "n", "title", "level", "body"])

    return documents.select("path", "content").mapInPandas(run, "path string, n int, title string, level int, body string")


def labelled_field(body: Column, labels: list[str]) -> Column:
    """What follows a bold label on its line, null if none does."""
    return F.nullif(F.trim(F.regexp_extract(body, rf"(?m)\*\*(?:{'|'.join(labels)})\*\*\s*[:：]?\s*([^\n]+)", 1)), F.lit(""))


def heading_name(title: Column) -> Column:
    """A heading without numbering, brackets and quotes; the title itself if fewer than two characters remain."""
    clean = F.regexp_replace(title, r"^\s*(?:\d+[.)]|[①-⑳])\s*", "")
    clean = F.trim(F.regexp_replace(F.regexp_replace(clean, r"\[[^\]]*\]|\([^)]*\)", ""), "[\"'“”‘’*]", ""))
    return F.when(F.length(clean) >= 2, clean).otherwise(F.trim(title))
