"""Toxicity by two class-conditional Kneser-Ney models over word pairs, words and openings.

Each class predicts a word from the word before it (a mark before the first). Pairs are counted
by occurrences, shorter units by continuations: a word by the different words it follows in the
class, its opening of six letters by the words that have it, that of four likewise. Absolute
discounting takes D from each count and hands the mass to the next shorter unit; the last one's
share comes from continuation counts that both classes share, so a rare or unseen expression is
judged by its parts. Pairs have a discount of 1: a pair seen once in a class leaves all its mass
to the backoff, and counts for its first word's context and its second word's continuations.

A document's evidence are two log-likelihood ratios of the toxic and the ordinary model, both
normalised by length: that of the whole text, the mean of its words, and that of its most toxic run
of words, so that a few insults count in a long text too. Runs have 1, 2, 4, ... words or all of
them; a run's ratio is divided by its length and PRIOR, as if so many words of no evidence belonged
to it, which keeps a single odd word from weighing as much as a passage. A logistic scale of the
two, whose weights are never negative, is fitted on labelled documents that the counts have not
seen, and gives a score from 0 to 1.

Null or empty texts, and texts without letters, have no evidence: they get the score of zero
evidence. Documents with equal texts get equal scores; rows that repeat an id are each scored, and
each counts where its id is labelled. Without labels of both classes every score is 0. Extra
columns are ignored, or carried along by keep_clean().

Every unit keeps its own ratio, words seen once too; 64-bit hashes tell units apart. Up to
`MOST_UNITS` units, counted first, are broadcast, those seen most often. The others stay a table:
documents are dealt into chunks, and the distinct units of each chunk that a broadcast bit table
has of them are joined with it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import bit_table, bucket_of_id, discard, fit_logistic, in_bit_table, join_labels, stage, table_bits
from waymark.session import ship

WORD = re.compile(r"[^\W\d_]+")
#: Letters in an opening; words in the runs that are scored, beside whole texts; words of no evidence that a run is counted with.
LONG, SHORT, RUNS, PRIOR = 6, 4, (1, 2, 4, 8, 16, 32), 0.5
DISCOUNT, PAIR_DISCOUNT = 0.75, 1.0
#: Units that are broadcast at most, at 14 bytes each; documents in a chunk where units are joined.
MOST_UNITS, CHUNK = 8_000_000, 4000
#: Parts in which the units come to the driver; occurrences that count as the most.
LOOKUP_PARTS, OFTEN = 16, 10_000
#: Documents that a task looks at together.
SOME = 400
#: The hash of the mark before the first word.
START = np.int64(0x5851F42D4C957F2D)
#: A word's ratio counts within these, so that a passage learnt word for word does not outweigh all else.
LEAST, MOST = -1.0, 20.0
EVIDENCE = ["mean_ratio", "run_ratio"]


@dataclass
class Lookup:
    """Ratios of units by their hashes, which are sorted, and for words what they add as a context."""

    hashes: np.ndarray
    ratios: np.ndarray
    contexts: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, ratios: np.ndarray, contexts: np.ndarray) -> Lookup:
        order = np.argsort(hashes)
        return cls(hashes[order], ratios[order], contexts[order].astype(np.float16))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which are there, their ratios and contexts (0 for the others)."""
        if not self.hashes.size:
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.float32), np.zeros(len(hashes), np.float32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.hashes.size - 1)
        hit = self.hashes[at] == hashes
        return hit, np.where(hit, self.ratios[at], np.float32(0)), np.where(hit, self.contexts[at].astype(np.float32), np.float32(0))


class Lookups:
    """Several lookups as one; a unit is in one of them at most."""

    def __init__(self, *lookups: Lookup):
        self.lookups = lookups

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [lookup.find(hashes) for lookup in self.lookups]
        return tuple(reduce(np.add, x) for x in zip(*found, strict=True))


@dataclass
class Scale:
    """What an unseen unit adds at each level; the logistic scale."""

    unseen: list[float]
    weights: np.ndarray
    bias: float


@dataclass
class Model:
    """lookup: the units seen most often, few enough to broadcast; units: unit (its hash), ratio and context of the others, and rest, a bit table of these, if there are others."""

    units: DataFrame | None
    rest: np.ndarray | None
    lookup: Lookup | None
    scale: Scale


def hashes_of(units: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(u, 42) for u in units), np.uint64, len(units)).astype(np.int64)


def openings(word: str) -> tuple[str, str, str]:
    return f"0{word}", f"1{word[:LONG]}", f"2{word[:SHORT]}"


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ second.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def words_in(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of the texts; of all their words one after another, which it is; how many words each text has."""
    found = [WORD.findall(t.lower()) if t else [] for t in texts]
    ids: dict[str, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for words in found for w in words), np.int64)
    return list(ids), flat, np.fromiter(map(len, found), np.int64, len(found))


def before(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The value before each one in its text; START before the first."""
    out = np.r_[START, values[:-1]][: values.size]
    first = np.cumsum(sizes) - sizes
    out[first[sizes > 0]] = START
    return out


def count_units(labelled: DataFrame) -> DataFrame:
    """kind, a, b, c1, c0 over rows of (text, toxic), all of which count.

    Kind 0: the hashes of a pair of words, its toxic and ordinary occurrences; 1 and 2: the hashes
    of a word and its opening, and of an opening and its shorter one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (batch.slice(k, SOME) for batch in batches for k in range(0, batch.num_rows, SOME)):
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            words, flat, sizes = words_in(batch.column(0).to_pylist())
            units = [hashes_of(list(x)) for x in zip(*map(openings, words), strict=True)] if words else [np.zeros(0, np.int64)] * 3
            second = units[0][flat]
            first = before(second, sizes)
            order = np.lexsort((second, first))
            first, second, classes = first[order], second[order], np.repeat(toxic, sizes)[order]
            new = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]) if first.size else np.zeros(0, np.int64)
            ones = np.add.reduceat(classes, new) if new.size else np.zeros(0, np.int64)
            counts = np.diff(np.r_[new, first.size])
            none = np.zeros(len(words), np.int64)
            rows = [(0, first[new], second[new], ones, counts - ones), (1, units[0], units[1], none, none), (2, units[1], units[2], none, none)]
            for kind, *columns in rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(columns[0].size, kind, np.int32)), *map(pa.array, columns)], names=["kind", "a", "b", "c1", "c0"])

    ship(labelled.sparkSession)
    found = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "kind int, a long, b long, c1 long, c0 long")
    return found.groupBy("kind", "a", "b").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))


def _discounted(count: str, total: Column | float, kinds: Column | float, below: Column) -> Column:
    """(max(c - D, 0) + D * kinds * below) / total"""
    return (F.greatest(F.col(count) - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * below) / total


def log_ratios(counts: DataFrame) -> tuple[DataFrame, list[float]]:
    """unit (its hash), ratio, context and seen (how often; openings always are), staged; and what an unseen word, opening or shorter opening adds."""
    pairs = counts.filter("kind = 0").select("a", "b", "c1", "c0")
    seen = lambda c, k: F.count_if(F.col(f"{c}{k}") > 0)
    continued = pairs.groupBy(F.col("b").alias("word")).agg(seen("c", 1).alias("c1"), seen("c", 0).alias("c0"))
    named = counts.filter("kind = 1").select(F.col("a").alias("word"), F.col("b").alias("p6"))
    shorter = counts.filter("kind = 2").select(F.col("a").alias("p6"), F.col("b").alias("p4"))
    words = stage(continued.join(named, "word").join(shorter, "p6"), "words")

    def continuations(by: list[str]) -> DataFrame:
        return words.groupBy(*by).agg(seen("c", 1).alias("t1"), seen("c", 0).alias("t0"), F.count("*").alias("t"))

    six, four = continuations(["p6", "p4"]), continuations(["p4"])
    total = words.agg(F.sum("c1"), F.sum("c0"), seen("c", 1), seen("c", 0)).first()
    of6 = six.agg(seen("t", 1), seen("t", 0)).first()
    of4 = four.agg(seen("t", 1), seen("t", 0), F.sum("t")).first()
    if not total[0] or not total[1]:
        raise LookupError("both classes need words")
    (all1, all0, kinds1, kinds0), (six1, six0), (four1, four0, pooled) = total, of6, of4
    shared = F.col("t") / float(pooled)
    four = four.select("p4", F.col("t").alias("t4"), *(_discounted(f"t{k}", kinds, fours, shared).alias(f"q{k}") for k, kinds, fours in ((1, kinds1, four1), (0, kinds0, four0))))
    six = six.join(four, "p4").select("p6", "p4", F.col("t").alias("t6"), "t1", "t0", *(_discounted(f"t{k}", kinds, sixes, F.col(f"q{k}") * F.col("t") / F.col("t4")).alias(f"s{k}") for k, kinds, sixes in ((1, kinds1, six1), (0, kinds0, six0))))
    own = words.join(six.drop("p4"), "p6").select("word", *(_discounted(f"c{k}", float(n), kinds, F.col(f"s{k}") / F.col("t6")).alias(f"own{k}") for k, n, kinds in ((1, all1, kinds1), (0, all0, kinds0))))
    own = stage(own, "own")

    # a pair has mass of its own only where it is seen twice in a class
    context = pairs.groupBy(F.col("a").alias("word")).agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"), seen("c", 1).alias("t1"), seen("c", 0).alias("t0"))
    passed = lambda k: F.when(F.col(f"n{k}") > 0, PAIR_DISCOUNT * F.col(f"t{k}") / F.col(f"n{k}")).otherwise(1.0)
    context = context.select("word", "n1", "n0", passed(1).alias("l1"), passed(0).alias("l0"))
    often = pairs.filter(F.greatest("c1", "c0") > PAIR_DISCOUNT).join(context.withColumnRenamed("word", "a"), "a").join(own.withColumnRenamed("word", "b"), "b")
    of = lambda k: F.when(F.col(f"n{k}") > 0, F.greatest(F.col(f"c{k}") - PAIR_DISCOUNT, F.lit(0.0)) / F.col(f"n{k}")).otherwise(0.0) + F.col(f"l{k}") * F.col(f"own{k}")
    ratio = lambda a, b: F.log(a / b).cast("float").alias("ratio")
    none = F.lit(0.0).cast("float").alias("context")
    seen_often = F.lit(OFTEN).cast("long").alias("seen")
    pair = often.select("a", "b", ratio(of(1), of(0)), (F.col("c1") + F.col("c0")).alias("seen")).mapInArrow(_pair_units, "unit long, ratio float, seen long").select("unit", "ratio", none, "seen")
    word = own.join(context, "word", "full_outer").select(F.col("word").alias("unit"), F.coalesce(ratio(F.col("own1"), F.col("own0")), F.lit(0.0).cast("float")), F.coalesce(F.log(F.col("l1") / F.col("l0")), F.lit(0.0)).cast("float"), F.coalesce(F.col("n1") + F.col("n0"), F.lit(1)).cast("long"))
    units = [pair, word, six.select("p6", ratio(F.col("s1"), F.col("s0")), none, seen_often), four.select("p4", ratio(F.col("q1"), F.col("q0")), none, seen_often)]
    lost = [np.log((kinds1 / all1) / (kinds0 / all0)), np.log((six1 / kinds1) / (six0 / kinds0)), np.log((four1 / kinds1) / (four0 / kinds0))]
    found = stage(reduce(DataFrame.union, units), "units")
    discard(words, own)
    return found, [float(x) for x in lost]


def _pair_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(pair_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy())), batch.column(2), batch.column(3)], names=["unit", "ratio", "seen"])


class Scorer:
    """Log ratios of words after words; words are remembered, up to `most` at a time."""

    def __init__(self, lookup: Lookup | Lookups, scale: Scale, most: int = 100_000):
        self.lookup, self.scale, self.most = lookup, scale, most
        self.known: dict[str, int] = {}
        self.table = [np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32)]
        self.start = lookup.find(np.array([START]))[2]

    def _learn(self, words: list[str]) -> np.ndarray:
        """Where each word stands in the table of hashes, ratios and contexts."""
        if len(self.known) > self.most:
            self.known.clear()
            self.table = [x[:0] for x in self.table]
        if new := [w for w in words if w not in self.known]:
            names = [hashes_of(list(x)) for x in zip(*map(openings, new), strict=True)]
            out, unseen, context = np.zeros(len(new), np.float32), self.scale.unseen, None
            for level in (2, 1, 0):
                hit, ratios, context = self.lookup.find(names[level])
                out = np.where(hit, ratios, out + unseen[level] if level < 2 else unseen[2])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.table = [np.concatenate(x) for x in zip(self.table, (names[0], out.astype(np.float32), context), strict=True)]
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """EVIDENCE of each text."""
        words, flat, sizes = words_in(texts)
        out = np.zeros((len(texts), len(EVIDENCE)))
        if not words:
            return out
        at = self._learn(words)[flat]
        hashes, ratios, contexts = (x[at] for x in self.table)
        first = before(hashes, sizes)
        begins = np.cumsum(sizes) - sizes
        ahead = np.r_[self.start, contexts[:-1]]
        ahead[begins[sizes > 0]] = self.start
        hit, pairs, _ = self.lookup.find(pair_hash(first, hashes))
        r = np.clip(np.where(hit, pairs, ratios + ahead).astype(np.float64), LEAST, MOST)
        there = np.flatnonzero(sizes)
        first, n = begins[there], sizes[there]
        total = np.add.reduceat(r, first)
        out[there, 0] = total / n
        best = total / (n + PRIOR)
        sums, owner = np.r_[0.0, np.cumsum(r)], np.repeat(np.arange(there.size), n)
        for w in RUNS:
            if w > r.size:
                break
            runs = (sums[w:] - sums[:-w]) / (w + PRIOR)
            runs[owner[: runs.size] != owner[w - 1 :]] = -np.inf  # over the end of a text
            runs = np.r_[runs, np.full(w - 1, -np.inf)]
            best = np.maximum(best, np.maximum.reduceat(runs, first))
        out[there, 1] = best
        return out


def units_of(texts: list[str | None]) -> np.ndarray:
    """The hashes of all units that scoring the texts may look up, each once."""
    words, flat, sizes = words_in(texts)
    own = hashes_of([f"0{w}" for w in words])[flat]
    return np.unique(np.r_[START, pair_hash(before(own, sizes), own), hashes_of([u for w in words for u in openings(w)])])


def _scored(df: DataFrame, model: Model, at: int, finish: Callable[[pa.RecordBatch, np.ndarray, Scale], pa.RecordBatch], schema) -> DataFrame:
    """finish(rows, features of the text in column `at`, scale) over all rows of df, which has a doc_id."""
    spark = df.sparkSession
    scale = model.scale
    ship(spark)

    def each(scorer: Scorer, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for some in (batch.slice(k, SOME) for k in range(0, batch.num_rows, SOME)):
            yield finish(some, scorer.features(some.column(at).to_pylist()), scale)

    if model.units is None:
        shared = spark.sparkContext.broadcast(model.lookup)  # of checked size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(shared.value, scale)
            for batch in batches:
                yield from each(scorer, batch)

        return df.mapInArrow(run, schema)

    often = [] if model.lookup is None else [model.lookup]
    shared = spark.sparkContext.broadcast((often, model.rest))  # both of checked size

    def needed(rows: pa.Table) -> pa.Table:
        often, rest = shared.value
        texts = rows.column(at)
        units = np.unique(np.concatenate([units_of(texts.slice(k, SOME).to_pylist()) for k in range(0, rows.num_rows, SOME)]))
        units = units[in_bit_table(rest, units)]
        for lookup in often:
            units = units[~lookup.find(units)[0]]
        return pa.table({"chunk": np.full(units.size, rows.column("__chunk")[0].as_py(), np.int64), "unit": units})

    def together(rows: pa.Table, found: pa.Table) -> pa.Table:
        own = Lookup.of(*(found.column(c).to_numpy() for c in ("unit", "ratio", "context")))
        scorer = Scorer(Lookups(*shared.value[0], own), scale)
        out = [done for batch in rows.drop_columns("__chunk").to_batches() for done in each(scorer, batch)]
        return pa.Table.from_batches(out)

    # texts are dealt once, by the same columns on both sides: a chunk's units are made, each once, where it lies
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-df.count() // CHUNK))))
    dealt = df.withColumn("__chunk", chunk).groupBy("__chunk")
    found = dealt.applyInArrow(needed, "chunk long, unit long").join(model.units, "unit")
    return dealt.cogroup(found.groupBy("chunk")).applyInArrow(together, schema)


def _evidence(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    def finish(rows: pa.RecordBatch, x: np.ndarray, _: Scale) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], *(pa.array(column) for column in x.T)], names=[*keep, *EVIDENCE])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    asked = df.select(*keep, "text", *(["doc_id"] if "doc_id" not in keep else []))
    return _scored(asked, model, len(keep), finish, f"{fields}, " + ", ".join(f"{c} double" for c in EVIDENCE))


def _lookup(units: DataFrame, n: int) -> Lookup:
    """The n units as arrays; they come to the driver in small blocks, one partition at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [batch.column(k).to_numpy().astype(kind).tobytes() for k, kind in enumerate((np.int64, np.float32, np.float16))]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in raw], names=["unit", "ratio", "context"])

    found, at = (np.empty(n, np.int64), np.empty(n, np.float32), np.empty(n, np.float16)), 0
    for row in units.select("unit", "ratio", "context").coalesce(LOOKUP_PARTS).mapInArrow(pack, "unit binary, ratio binary, context binary").toLocalIterator():
        size = len(row[0]) // 8
        for out, raw in zip(found, row, strict=True):
            out[at : at + size] = np.frombuffer(raw, out.dtype)
        at += size
    return Lookup.of(*found)


def _seen_at_least(units: DataFrame, most: int) -> tuple[int, int]:
    """The occurrences that at most `most` units reach, as few as may be, and how many units do."""
    sizes = units.groupBy(F.least("seen", F.lit(OFTEN)).alias("seen")).agg(F.count("*").alias("n")).collect()  # OFTEN rows at most
    least, n = OFTEN + 1, 0
    for times, size in sorted(sizes, reverse=True):
        if n + size > most:
            break
        least, n = times, n + size
    return least, n


def fit(documents: DataFrame, labels: DataFrame, may_learn: Column, most_scale: int = 20_000, most_units: int | None = None) -> Model | None:
    """Learns from the labelled documents for which may_learn holds; None without both classes.

    Four fifths of them give the counts, all of them; the rest, at most `most_scale` by the
    order of a hash, give the scale.
    """
    known = labels.filter(may_learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    for_scale = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    docs = documents.select("doc_id", "text")
    counts = stage(count_units(join_labels(docs, known.filter(~for_scale))), "counts")
    try:
        units, unseen = log_ratios(counts)
    except LookupError:
        return None
    finally:
        discard(counts)
    n = units.count()
    least, often = _seen_at_least(units, MOST_UNITS if most_units is None else most_units)
    lookup = _lookup(units.filter(F.col("seen") >= least) if often < n else units, often) if often else None
    others, rest = None, None
    if often < n:
        others = units.filter(F.col("seen") < least).select("unit", "ratio", "context")
        rest = bit_table(others.select("unit").coalesce(LOOKUP_PARTS), table_bits(n - often))
    else:
        discard(units)
    model = Model(others, rest, lookup, Scale(unseen, np.zeros(len(EVIDENCE)), 0.0))
    picked = known.filter(for_scale).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(most_scale)
    rows = _evidence(join_labels(docs, picked), model, ["toxic"]).toArrow()
    toxic, x = rows.column("toxic").to_numpy(), np.column_stack([rows.column(c).to_numpy() for c in EVIDENCE])
    if np.unique(toxic).size < 2:
        return None
    mean, spread = x.mean(0), x.std(0) + 1e-9
    kept, w = np.ones(len(EVIDENCE), bool), np.zeros(len(EVIDENCE))
    while kept.any():  # evidence for toxic never lowers the score
        own, b = fit_logistic(((x - mean) / spread)[:, kept], toxic, ridge=1e-4 + 0.3 / len(toxic))
        if (own >= 0).all():
            w[kept] = own
            break
        kept[np.flatnonzero(kept)[own < 0]] = False
    else:
        b = float(np.log(toxic.mean() / (1 - toxic.mean())))
    model.scale = Scale(unseen, w / spread, float(b - (w * mean / spread).sum()))
    return model


def score(documents: DataFrame, model: Model | None, keep: list[str], cutoff: float = 0.7) -> DataFrame:
    """`keep`, the evidence, score and predicted (1 if score >= cutoff)."""
    if model is None:
        return documents.select(*keep, *(F.lit(0.0).alias(c) for c in EVIDENCE), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    z = sum((F.col(c) * float(w) for c, w in zip(EVIDENCE, model.scale.weights, strict=True)), F.lit(model.scale.bias))
    scored = _evidence(documents, model, keep).withColumn("score", F.lit(1.0) / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def keep_clean(documents: DataFrame, model: Model | None, cutoff: float = 0.7) -> DataFrame:
    """The documents, all their columns, whose score is below cutoff."""
    if model is None:
        return documents

    def finish(rows: pa.RecordBatch, x: np.ndarray, scale: Scale) -> pa.RecordBatch:
        z = x @ scale.weights + scale.bias
        return rows.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < cutoff))

    return _scored(documents, model, documents.columns.index("text"), finish, documents.schema)


def learnable() -> Column:
    """Rows that labels may be learnt from."""
    return bucket_of_id(F.col("doc_id"), 3) != 1
