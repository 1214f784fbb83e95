"""Benchmark decontamination by greedy string tiling.

Words (runs of letters and digits, lower-cased) of documents and test items are hashed. Seeds are
runs of SEED words; the document's seeds join the items' seeds in Spark, which gives the pairs of
document and item that share a word run at all, and the item's share that seeds cover bounds what
tiles can cover, so pairs below the threshold end there. For the others, greedy string tiling
marks the longest common run of unmarked words again and again, from long to short by rolling
Karp-Rabin hashes whose length is found by halving, down to SEED words; tiles may stand in any order. A document is contaminated
by an item if its tiles cover at least `least` of the item's words.

Before the join, a bit table of fixed size drops seeds that no item has; a larger benchmark fills
the table and prunes less, and results stay the same. An item shorter than SEED words counts only
as a whole run; null texts and items without words match nothing. Ids may have any type with an
order. Equal texts under different item_ids each count, and so do different texts under one; rows
that repeat both count once; items without an id are not looked at. Documents are told apart by id,
null included, and text: equal rows get equal answers, and rows of one id with other texts their
own. The best item is that with the highest coverage, then the smallest item_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import HashedWords, discard, stage
from waymark.session import ship

WORD = re.compile(r"[^\W_]+")
SEED = 5
#: Bits of the table that prunes seeds.
BITS = 22
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def hashes(text: str | None, known: HashedWords) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, WORD.findall(text.lower())), np.uint64) if text else np.zeros(0, np.uint64)


def rolling(words: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2^64, multiplied by an odd base) of all runs of `length` words."""
    if words.size < length:
        return np.zeros(0, np.uint64)
    powers, shrink = _powers(1 << words.size.bit_length())
    sums = np.zeros(words.size + 1, np.uint64)
    np.cumsum(words * powers[: words.size], out=sums[1:])
    return (sums[length:] - sums[:-length]) * shrink[: words.size - length + 1]


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64, from the first on."""
    inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
    return tuple(np.cumprod(np.full(n, x), dtype=np.uint64) for x in (MULTIPLIER, inverse))


def seeds(words: np.ndarray) -> tuple[np.ndarray, int]:
    """Hashes of the seed runs, and their length: the whole text if it is shorter."""
    length = min(SEED, words.size)
    return (rolling(words, length), length) if length else (np.zeros(0, np.uint64), 0)


def _free_runs(free: np.ndarray, length: int) -> np.ndarray:
    """Where `length` unmarked words start."""
    sums = np.r_[0, np.cumsum(free)]
    return np.flatnonzero(sums[length:] - sums[:-length] == length)


def tile(doc: np.ndarray, item: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, words), longest first, then leftmost in the item and the document.

    The longest common run of unmarked words is found by halving: a run of some length has runs of
    all smaller ones. All tiles of that length are marked, then the next length is searched below.
    """
    free_doc, free_item = np.ones(doc.size, bool), np.ones(item.size, bool)
    tiles, most, shortest = [], min(doc.size, item.size), max(1, shortest)

    def shared(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of both sides' runs, and where unmarked runs start that the other side may have."""
        own, other = rolling(item, length), rolling(doc, length)
        at, there = _free_runs(free_item, length), _free_runs(free_doc, length)
        return own, other, at[np.isin(own[at], other[there])], there[np.isin(other[there], own[at])]

    while most >= shortest:
        low, high = shortest - 1, most
        while low < high:  # the greatest length with a common run, shortest - 1 if there is none
            length = (low + high + 1) // 2
            low, high = (length, high) if shared(length)[2].size else (low, length - 1)
        if low < shortest:
            break
        own, other, at, there = shared(low)
        places: dict[int, list[int]] = {}
        for k in there.tolist():
            places.setdefault(int(other[k]), []).append(k)
        for k in at.tolist():
            if not free_item[k : k + low].all():
                continue
            for j in places[int(own[k])]:
                if free_doc[j : j + low].all() and np.array_equal(doc[j : j + low], item[k : k + low]):
                    free_doc[j : j + low] = free_item[k : k + low] = False
                    tiles.append((j, k, low))
                    break
        most = low - 1
    return tiles


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, item (a hash of id and text) and text of every item with an id, rows that repeat both once."""
    named = benchmark.filter("item_id is not null").select("item_id", F.xxhash64("item_id", "text").alias("item"), "text")
    return named.dropDuplicates(["item"])


def _item_seeds(items: DataFrame) -> DataFrame:
    """seed, item, place and n_item (its words) of every seed of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = HashedWords()
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = hashes(text, known)
                found, _ = seeds(words)
                for k, x in enumerate((found.view(np.int64).tolist(), [item] * found.size, range(found.size), [words.size] * found.size)):
                    out[k] += x
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["seed", "item", "place", "n_item"])

    return items.select("item", "text").mapInArrow(run, "seed long, item long, place long, n_item long")


def _bits(item_seeds: DataFrame) -> np.ndarray:
    """The table of seeds that items have: 2^BITS flags, however many items there are."""
    slots = item_seeds.select(F.shiftrightunsigned("seed", 64 - BITS).alias("slot")).distinct().toPandas()["slot"].to_numpy()
    table = np.zeros(1 << BITS, bool)
    table[slots] = True
    return np.packbits(table)


def doc_key() -> list[Column]:
    """What names a document: hashes of its id, of any type, and of its text."""
    return [F.xxhash64("doc_id").alias("d"), F.xxhash64("text").alias("h")]


def _candidates(documents: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """d, h and n_words of every document; words and those of its seeds that pass the table, where there are any."""
    shared = documents.sparkSession.sparkContext.broadcast(bits)  # 2^BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = HashedWords(), np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            n, kept, found = [], [], []
            for text in batch.column(2).to_pylist():
                words = hashes(text, known)
                n.append(words.size)
                all_ = np.concatenate([rolling(words, k) for k in lengths]) if lengths else words[:0]
                hit = np.unique(all_[table[(all_ >> np.uint64(64 - BITS)).astype(np.int64)]])
                kept.append(words.view(np.int64) if hit.size else None)
                found.append(hit.view(np.int64) if hit.size else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(kept, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))], names=["d", "h", "n_words", "words", "seeds"])

    return documents.select(*doc_key(), "text").mapInArrow(run, "d long, h long, n_words long, words array<long>, seeds array<long>")


def _tiled(pairs: DataFrame) -> DataFrame:
    """Rows (d, h, words, item, its words) -> d, h, item, covered, n_tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, items = (batch.column(k).to_pylist() for k in (2, 4))
            found = []
            for doc, item in zip(docs, items, strict=True):
                a, b = (np.array(x, np.int64).view(np.uint64) for x in (doc, item))
                found.append(tile(a, b, min(SEED, b.size)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array([sum(x[2] for x in t) for t in found], pa.int64()), pa.array([len(t) for t in found], pa.int64())], names=["d", "h", "item", "covered", "n_tiles"])

    return pairs.select("d", "h", "words", "item", "item_words").mapInArrow(run, "d long, h long, item long, covered long, n_tiles long")


def _item_words(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = HashedWords()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashes(t, known).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["item", "item_words"])

    return items.select("item", "text").mapInArrow(run, "item long, item_words array<long>")


def contamination(documents: DataFrame, benchmark: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """All documents (d, h, n_words), and the pairs (d, h, item_id, item, coverage, n_tiles) with coverage >= least, each once."""
    ship(documents.sparkSession)
    items = stage(items_of(benchmark), "items")
    item_seeds = stage(_item_seeds(items), "item-seeds")
    # an item of fewer than SEED words has one seed of its own length
    lengths = [r[0] for r in item_seeds.select(F.least(F.lit(SEED), "n_item").cast("int")).distinct().collect()]
    found = stage(_candidates(documents, _bits(item_seeds), lengths), "seeds")
    # how many of an item's words its shared seeds can cover bounds what tiles cover
    held = found.filter("seeds is not null").dropDuplicates(["d", "h"])
    hits = held.select("d", "h", F.explode("seeds").alias("seed"))
    shared = hits.join(item_seeds, "seed").groupBy("d", "h", "item", "n_item").agg(F.collect_set("place").alias("places"))
    covers = F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.least(F.lit(SEED), F.col("n_item")) - 1)))
    pairs = shared.filter(F.size(F.array_distinct(covers)) >= least * F.col("n_item")).select("d", "h", "item", "n_item")
    rows = pairs.join(held.select("d", "h", "words"), ["d", "h"]).join(_item_words(items), "item")
    tiled = _tiled(rows).join(pairs, ["d", "h", "item"]).withColumn("coverage", F.col("covered") / F.col("n_item"))
    leaks = stage(tiled.filter(F.col("coverage") >= least).join(items.select("item", "item_id"), "item").select("d", "h", "item_id", "item", "coverage", "n_tiles"), "leaks")
    discard(items, item_seeds)
    return found.select("d", "h", "n_words"), leaks


def per_document(documents: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, n_words, contaminated, n_items, best_item, coverage (of the best item, else 0), n_tiles of every row."""
    docs, pairs = contamination(documents, benchmark, least)
    order = F.struct((-F.col("coverage")).alias("c"), "item_id", "item")
    best = pairs.groupBy("d", "h").agg(F.count("*").alias("n_items"), F.min_by(F.struct("item_id", "coverage", "n_tiles"), order).alias("best"))
    sizes = docs.dropDuplicates(["d", "h"]).join(best, ["d", "h"], "left")
    return documents.select("doc_id", *doc_key()).join(sizes, ["d", "h"]).select(
        "doc_id", "n_words", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.col("best.item_id").alias("best_item"), F.round(F.coalesce("best.coverage", F.lit(0.0)), 6).alias("coverage"), F.coalesce("best.n_tiles", F.lit(0)).alias("n_tiles"),
    )


def without_leaks(documents: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, all columns, that no item's tiles cover by `least` of it."""
    leaked = contamination(documents, benchmark, least)[1].select(F.col("d").alias("__d"), F.col("h").alias("__h")).distinct()
    keyed = documents.withColumns(dict(zip(("__d", "__h"), doc_key(), strict=True)))
    return keyed.join(leaked, ["__d", "__h"], "left_anti").select(*documents.columns)
