"""Token counts by section through offset-mapped attribution.

A whole document is encoded once. Byte-level tokens spell the text's bytes, so their running
lengths are their spans; sections are spans too and tile the text (by default a section is a line
with the newline that ends it; `separator` is a regular expression whose matches end sections).
An interval join of both span lists gives each token to the section that holds it. A token that
crosses a boundary goes by `rule`: "majority" (the section with most of its bytes, the earlier on
a tie), "first" or "last" (the first or last section it touches). Every token is counted once, so
a document's sections add up to its tokens.

Null and empty texts have one section of no characters and no tokens. A text that ends with a
separator has no empty section after it. Extra columns are dropped except those in `keep`.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.session import ship

RULES = ("majority", "first", "last")


@lru_cache(maxsize=2)
def tokenizer(path: str | None, pattern: str | None):
    """A tiktoken encoding from a rank file, and the byte length of each id; one per Python worker."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if not os.path.exists(path):
        path = public_tokenizers.path(os.path.basename(path))
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    lens = np.zeros(max(ranks.values()) + 1, np.int64)
    lens[list(ranks.values())] = [len(b) for b in ranks]
    return tiktoken.Encoding("own", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lens


def attribute(sizes: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section and boundary-crossing tokens given to it, from token sizes and section ends (in bytes)."""
    stop = np.cumsum(sizes)
    first, last = np.searchsorted(ends, stop - sizes, "right"), np.searchsorted(ends, stop - 1, "right")
    crossing = np.flatnonzero(first != last)
    chosen = (last if rule == "last" else first).copy()
    if rule == "majority":
        for k in crossing.tolist():
            inside = np.arange(first[k], last[k] + 1)
            spans = np.minimum(ends[inside], stop[k]) - np.maximum(np.r_[0, ends][inside], stop[k] - sizes[k])
            chosen[k] = inside[spans.argmax()]
    return np.bincount(chosen, minlength=ends.size), np.bincount(chosen[crossing], minlength=ends.size)


def section_ends(raw: bytes, separator: re.Pattern[bytes]) -> np.ndarray:
    """Where sections end, in bytes; the last ends with the text."""
    ends = [m.end() for m in separator.finditer(raw) if m.end()]
    if not ends or ends[-1] < len(raw):
        ends.append(len(raw))
    return np.array(ends, np.int64)


def by_section(df: DataFrame, keep: list[str], separator: str = "\n", rule: str = "majority", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """`keep`, section (from 0), start_char, end_char, n_tokens, n_crossing of every section of every row."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lens = tokenizer(vocabulary, pattern)
        cut = re.compile(separator.encode())
        for batch in batches:
            for some in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                columns: list[list[np.ndarray]] = [[], [], [], [], []]
                rows = []
                for text in some.column(len(keep)).to_pylist():
                    raw = (text or "").encode()
                    ends = section_ends(raw, cut)
                    counts, crossing = attribute(lens[np.array(encoding.encode_ordinary(text or ""), np.int64)], ends, rule)
                    chars = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)][ends]
                    rows.append(ends.size)
                    for column, values in zip(columns, (np.arange(ends.size), np.r_[0, chars[:-1]], chars, counts, crossing), strict=True):
                        column.append(values)
                kept = pa.array(np.repeat(np.arange(some.num_rows), rows))
                yield pa.RecordBatch.from_arrays([*(some.column(k).take(kept) for k in range(len(keep))), *(pa.array(np.concatenate(c).astype(np.int64)) for c in columns)], names=[*keep, "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    numbers = ("section", "start_char", "end_char", "n_tokens", "n_crossing")
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in numbers)])
    ship(df.sparkSession)
    return df.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)
