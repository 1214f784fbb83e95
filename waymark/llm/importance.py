"""Importance resampling towards a target, by hashed word runs.

Features of a text are its runs of 1 to `longest` consecutive words, joined by one space, repeats
counted; a word is a run of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A
feature's bucket is the crc32 of its UTF-8 bytes modulo `buckets`. The gain of a bucket is the
scaled log of how much likelier the target's features fall there than the documents', each count
raised by one; a text's weight is the sum over its features. Gumbel noise from a hash of the id is
added, and the highest scores among texts of at least `least_words` words are drawn: a sample
without replacement in proportion to the weights.

Words are found by a byte automaton: a table classifies the bytes of an Arrow column's buffer,
differences of the classes are word starts and ends (every byte of a character beyond ASCII is a
word's), and table-driven CRCs advance by one byte at all starts together. A word that is still
going after LONG bytes ends by the library's crc32, from the state it has.

Null texts have no words, and weight 0; empty tables give empty results, an empty target gives
gains as by its counts of zero. A null id has the noise of an empty id and comes last among equal
scores; rows that repeat an id are drawn each for itself. Other columns are kept as asked for.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import stage
from waymark.llm.shingles import blocks
from waymark.operators.ranks import numbered
from waymark.session import ship

BUCKETS, LONGEST, LEAST_WORDS, SEED = 10_000, 1, 20, 2024
#: Bytes of a word that advance together with those of all other words.
LONG = 48


def crc_table() -> np.ndarray:
    """The 256 steps of the reflected CRC of polynomial 0xEDB88320."""
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, (rows >> 1) ^ np.uint32(0xEDB88320), rows >> 1)
    return rows


STEPS = crc_table()
_bytes = np.arange(256)
#: What each byte becomes, 0 where no word has it.
CLASS = np.where((_bytes >= 128) | ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122)), _bytes, 0).astype(np.uint8)
CLASS[65:91] = _bytes[97:123]


def find_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The classified bytes of texts that lie one after another, and each word's start, end and text."""
    lowered = CLASS[data]
    there = np.zeros(data.size + 2, np.int8)
    there[1:-1] = lowered != 0
    change = np.diff(there)
    starts, stops = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    # a word ends where its text does, even if the next text goes on with word bytes
    inner = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < data.size)]
    cut = inner[(lowered[inner - 1] != 0) & (lowered[inner] != 0)] if inner.size else inner
    if cut.size:
        cut = np.unique(cut)
        starts, stops = np.sort(np.r_[starts, cut]), np.sort(np.r_[stops, cut])
    return lowered, starts, stops, np.searchsorted(ends, starts, "right")


def advanced(state: np.ndarray, lowered: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC states after the bytes that start at `starts`, `sizes` of them; all advance together."""
    order = np.argsort(np.minimum(sizes, LONG + 1).astype(np.uint8), kind="stable")[::-1]
    own, at, left = state[order], starts[order], sizes[order]
    live = np.searchsorted(-np.minimum(left, LONG + 1), -np.arange(LONG + 1), "left")  # how many have more than k bytes
    for k in range(LONG):
        n = live[k]
        if not n:
            break
        own[:n] = STEPS[(own[:n] ^ lowered[at[:n] + k]) & 0xFF] ^ (own[:n] >> 8)
    for i in range(live[LONG]):
        own[i] = zlib.crc32(lowered[at[i] + LONG : at[i] + left[i]].tobytes(), int(own[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(own)
    out[order] = own
    return out


def features(data: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every feature, and the number of words of each text."""
    lowered, starts, stops, text = find_words(data, ends)
    sizes = stops - starts
    first = np.arange(starts.size)
    state = np.full(starts.size, 0xFFFFFFFF, np.uint32)
    found, owners = [], []
    for n in range(longest):
        if n:  # one blank, then the word n places on, where the text has it
            more = first[first + n < starts.size]
            on = text[more + n] == text[more]
            first, state = more[on], state[: more.size][on]  # the last ones have no word n places on
            state = STEPS[(state ^ 32) & 0xFF] ^ (state >> 8)
        state = advanced(state, lowered, starts[first + n], sizes[first + n])
        found.append((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
        owners.append(text[first])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), np.bincount(text, minlength=ends.size)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall in each bucket; a task sends a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, ends in blocks(batch.column(0)):
                total += np.bincount(features(data, ends, buckets, longest)[0], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    ship(texts.sparkSession)
    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # a row a bucket
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the target's share of each bucket over the raw share, counts raised by one."""
    s, t, size = float(raw.sum()), float(target.sum()), len(raw)
    one = lambda a, b: math.floor(1000 * math.log(((b + 1.0) * (s + size)) / ((a + 1.0) * (t + size))))
    return np.array([one(a, b) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(documents: DataFrame, target: DataFrame, keep: list[str], buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """`keep`, n_words, n_features and weight of every document."""
    worth = gains(bucket_counts(documents, buckets, longest), bucket_counts(target, buckets, longest))
    shared = documents.sparkSession.sparkContext.broadcast(worth)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, ends in blocks(batch.column(len(keep))):
                bucket, text, words = features(data, ends, buckets, longest)
                weight = np.zeros(ends.size, np.int64)
                np.add.at(weight, text, shared.value[bucket])
                n = np.bincount(text, minlength=ends.size)
                kept = [c.slice(at, ends.size) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, (words, n, weight))], names=[*keep, "n_words", "n_features", "weight"])

    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*keep, "text").mapInArrow(run, f"{fields}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 x) of Gumbel noise x from the first 32 bits of a hash of seed and id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, percent: int, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, score and more) with rank: 1 for the highest score of those drawn, null for all others.

    Drawn are floor(percent / 100) of the texts with enough words; equal scores go by doc_id.
    """
    held = stage(scored, "weighed")
    able = held.filter(F.col("n_words") >= least_words)
    most = percent * able.count() // 100
    ranked = numbered(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    rank = F.when(F.col("rank") <= most, F.col("rank"))
    return ranked.withColumn("rank", rank).unionByName(held.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, least_words: int = LEAST_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep`, n_words, n_features, weight, score and rank of every document; rank is null where it isn't drawn."""
    rows = weighed(documents, target, ["doc_id", *keep], buckets, longest)
    return drawn(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), percent, least_words)
