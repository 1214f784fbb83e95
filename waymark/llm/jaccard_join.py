"""Set-similarity self-join of documents on word shingles, with several global token orders.

A document's set holds the 64-bit hashes of its distinct runs of WORDS words (A-Z lower-cased,
split at ASCII blanks); a shorter document has its whole sequence as one; one without words has
none and links with nothing. Two documents link when 4 * |both| >= 3 * |either|, that is at a
Jaccard similarity of 0.75.

1. Equal sets become one class, represented by its smallest doc_id.
2. Under any global order of tokens, linked sets share a token among the first n - ceil(3n/4) + 1
   of each. The very first tokens under several orders (rarest first, and hash orders) group most
   near copies: each class is compared with the smallest of its group only, so a group of any
   size costs one comparison a member, and what links is merged.
3. The whole prefixes under the rarest-first order are then joined, but only for tokens that
   still lie in different components; length, position and parity filters apply in the join.
4. A pair that is left must also share a prefix token under each of CROSSED hash orders, which is
   looked up in prefixes; only what passes all orders is verified, on the words of its texts.

The parity filter: a set's parity has a bit for each of 64 * PARITIES slots, the oddness of the
number of its tokens there. Sets whose parities differ in d bits differ in d tokens at least, and
sets that link differ in a seventh of |x| + |y| at most.

Steps 2 to 4 find every link between components: a pair that step 3 doesn't generate is in one
component already or can't link. Rarity is the count of a token's slot in a table of fixed size
over all documents; it decides speed, not results. Tables that prune by a bit per slot are sized by
what they hold, up to a bound; beyond it they only ever let more through.

Rows with null ids take part in nothing and keep a null component. Repeated rows with the same id
and text get the same answer; rows with one id and several texts count as one document with links
of all. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import bit_table, discard, in_bit_table, stage, table_bits
from waymark.llm.shingles import WORDS, blocks, distinct, fingerprints, heads_of, mixed, parities, per_segment, prefix_size, rarity_classes, rarity_keys, words_of

#: Longs of a set's parity.
PARITIES = 8
#: Keys of the hash orders, beside the rarest-first order; pairs must share prefixes under the first CROSSED of them.
ORDERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
CROSSED = 2


def may_agree(a: str, b: str) -> Column:
    """Whether the parities <a>0.. and <b>0.. of sets of n<a> and n<b> tokens leave room for a link."""
    apart = sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(PARITIES)), F.lit(0))
    return 7 * apart <= F.col(f"n{a}") + F.col(f"n{b}")


def describe(documents: DataFrame) -> DataFrame:
    """doc_id, n, fingerprint (f1, f2), heads h0.. (first token of each order), parity s0.. and the rarest-first prefix."""
    classes = documents.sparkSession.sparkContext.broadcast(rarity_classes(documents, False))  # of fixed size
    numbers = ["n", "f1", "f2", *(f"h{k}" for k in range(len(ORDERS) + 1)), *(f"s{k}" for k in range(PARITIES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, ends in blocks(batch.column(1)):
                segment, tokens = words_of(data, ends, False).tokens()
                segment, keys = distinct(segment, rarity_keys(tokens, classes.value))
                out, sizes = np.zeros((len(numbers), ends.size), np.int64), np.zeros(ends.size, np.int64)
                docs, first, n = per_segment(segment)
                if docs.size:
                    firsts = [np.minimum.reduceat(mixed(keys ^ k), first).view(np.int64) for k in ORDERS]
                    out[:, docs] = [n, *fingerprints(keys, first), keys[first].view(np.int64), *firsts, *parities(keys, first, n, PARITIES).T]
                    sizes[docs] = prefix_size(n)
                held = heads_of(keys, first, n, sizes[docs])
                prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), held.values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, ends.size), *map(pa.array, out), prefix], names=["doc_id", *numbers, "prefix"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in numbers) + ", prefix array<long>")


def _pruned(documents: DataFrame, ids: DataFrame, then: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | None = None, fields: str = "text string") -> DataFrame:
    """doc_id and text of the documents whose ids may be among ids (id), or what `then` makes of them."""
    table = documents.sparkSession.sparkContext.broadcast(bit_table(ids.select(F.xxhash64("id")), table_bits(ids.count())))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.filter(pa.array(in_bit_table(table.value, batch.column(2).to_numpy()))).select(["doc_id", "text"])
            yield from then(there) if then else [there]

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.filter("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id")).mapInArrow(run, f"doc_id {kind}, {fields}")


def crossed(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets share prefix tokens under each of CROSSED hash orders too.

    Only prefixes travel, each token as 32 of its bits.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))

    def prefixes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, data, ends in blocks(batch.column(1)):
            columns = []
            segment, tokens = words_of(data, ends, False).tokens()
            for key in ORDERS[:CROSSED]:
                docs, keys = distinct(segment, mixed(tokens ^ key))
                docs, first, n = per_segment(docs)
                sizes = np.zeros(ends.size, np.int64)
                sizes[docs] = prefix_size(n)
                values = heads_of(keys, first, n, sizes[docs]).values.to_numpy()
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values.astype(np.int32))))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, ends.size), *columns], names=["doc_id", *(f"o{k}" for k in range(CROSSED))])

    orders = [f"o{k}" for k in range(CROSSED)]
    held = stage(_pruned(documents, ids, prefixes, ", ".join(f"{c} array<int>" for c in orders)), "orders")
    side = lambda s: held.select(F.col("doc_id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in orders))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    meet = reduce(and_, (F.arrays_overlap(f"a_{c}", f"b_{c}") for c in orders))
    found = stage(both.filter(meet).select("a", "b").distinct(), "crossed")
    discard(held)
    return found


def token_set(text: str | None) -> set[tuple[bytes, ...]]:
    words = text.encode().lower().split() if text else []
    return {tuple(words[k : k + WORDS]) for k in range(max(1, len(words) - WORDS + 1))} if words else set()


def links(x: set, y: set) -> bool:
    both = len(x & y)
    return both > 0 and 4 * both >= 3 * (len(x) + len(y) - both)


def verified(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. Texts travel, which compress; sets are made again where they meet."""
    pairs = crossed(documents, pairs)
    texts = _pruned(documents, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    rows = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for some in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                keep = []
                for ta, tb in zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True):
                    if held is None or tb != last:  # rows arrive by b, so one text often serves many
                        last, held = tb, token_set(tb)
                    keep.append(links(token_set(ta), held))
                yield some.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = documents.schema["doc_id"].dataType.simpleString()
    found = stage(rows.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}").distinct(), "links")
    discard(pairs)
    return found


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes of the edges (a, b), by alternating large and small stars."""
    e = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not e.isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, stage(small, "edges")
        # stars only, and the same as before
        if e.join(before, ["u", "v"], "left_anti").isEmpty() and before.join(e, ["u", "v"], "left_anti").isEmpty():
            discard(before)
            break
        discard(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def _into_component(df: DataFrame, column: str, components: DataFrame) -> DataFrame:
    """df with column replaced by its component, where it has one."""
    found = components.select(F.col("node").alias(column), F.col("component").alias("__component"))
    return df.join(found, column, "left").withColumn(column, F.coalesce("__component", column)).drop("__component")


def link(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    described = stage(describe(documents), "sets")
    there = described.filter("n > 0 and doc_id is not null")
    heads, parities = [f"h{k}" for k in range(len(ORDERS) + 1)], [f"s{k}" for k in range(PARITIES)]
    classes = stage(there.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), *(F.min(c).alias(c) for c in ("n", *heads, *parities))), "classes")
    signed = lambda s: classes.select(F.col("rep").alias(s), F.col("n").alias(f"n{s}"), *(F.col(c).alias(f"{s}{c[1:]}") for c in parities))

    # the smallest of each group that shares the first token of an order
    first = classes.select("rep", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(h).alias("head")) for k, h in enumerate(heads)))).alias("x")).select("rep", "n", "x.*")
    leaders = first.groupBy("k", "head").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).filter("b < last").drop("last")
    pairs = first.join(leaders, ["k", "head"]).filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    pairs = stage(pairs.join(signed("a"), "a").join(signed("b"), "b").filter(may_agree("a", "b")).select("a", "b"), "pairs")
    found = verified(documents, pairs)
    components = connected_components(found)
    member = stage(_into_component(classes.select("rep", F.col("rep").alias("component")), "component", components), "members")

    # tokens of whole prefixes that lie in more than one component
    discard(pairs, found)
    prefixes = there.join(member, there["doc_id"] == member["rep"]).select("component", F.explode("prefix").alias("token"))
    split = stage(prefixes.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("token"), "tokens")
    entries = _entries(there, split).join(member, "rep").join(split, "token").join(classes.select("rep", *parities), "rep").distinct()
    entries = stage(entries, "entries")
    # the component with most of a token's entries meets the others; its own entries never meet each other
    per_component = entries.groupBy("token", "component").agg(F.count("*").alias("__n"))
    largest = per_component.groupBy("token").agg(F.max(F.struct("__n", "component"))["component"].alias("largest"))
    marked = entries.join(largest, "token").withColumn("main", F.col("component") == F.col("largest"))
    side = lambda s: marked.select("token", F.col("component").alias(f"c{s}"), F.col("main").alias(f"main_{s}"), F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("pos").alias(f"p{s}"), *(F.col(c).alias(f"{s}{c[1:]}") for c in parities))
    meet = (F.col("ca") != F.col("cb")) & (F.col("main_b") | (F.col("a") < F.col("b")))
    may_link = (4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")) & (7 * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= 3 * (F.col("na") + F.col("nb")))
    pairs = side("a").filter("not main_a").join(side("b"), "token").filter(meet & may_link & may_agree("a", "b"))
    pairs = stage(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    more_found = verified(documents, pairs)
    more = _into_component(_into_component(more_found, "a", member.withColumnRenamed("rep", "node")), "b", member.withColumnRenamed("rep", "node"))
    final = _into_component(member, "component", connected_components(more))
    known = stage(classes.select("f1", "f2", "rep").join(final, "rep").select("f1", "f2", "component"), "components")
    discard(classes, member, split, entries, pairs, more_found)
    rows = described.select("doc_id", F.col("n").alias("n_shingles"), "f1", "f2")
    lone = rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.filter("n_shingles > 0 and doc_id is not null").join(known, ["f1", "f2"]).select("doc_id", "n_shingles", F.col("component").alias("component_id")).union(lone)


def _entries(described: DataFrame, tokens: DataFrame) -> DataFrame:
    """rep, n, token, pos of the prefix tokens that may be among tokens."""
    table = described.sparkSession.sparkContext.broadcast(bit_table(tokens, table_bits(tokens.count())))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            hit = np.flatnonzero(in_bit_table(table.value, flat))
            row = np.repeat(np.arange(batch.num_rows), sizes)[hit]
            pos = hit - (np.cumsum(sizes) - sizes)[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(flat[hit]), pa.array(pos.astype(np.int64))], names=["rep", "n", "token", "pos"])

    kind = described.schema["doc_id"].dataType.simpleString()
    return described.select(F.col("doc_id").alias("rep"), "n", "prefix").mapInArrow(run, f"rep {kind}, n long, token long, pos long")
