"""Line deduplication by an exact set-similarity self-join.

A line's tokens are its distinct runs of WORDS words (A-Z lower-cased, split at ASCII blanks); a
line with fewer words has its whole sequence as one token. Two lines match when the Jaccard
similarity of their token sets is at least 0.75. Of matching lines the first, by doc_id, text hash
and line number, stays; a line is removed if it matches any earlier line.

Tokens are ordered by rarity, that is by the class of their slot's count over all lines in a table
of fixed size, then by hash. Equal sets fall together first. Matching sets share a token among the
first n - ceil(3n/4) + 1 of each (prefix filter); sizes must allow the similarity (length filter),
and so must what is left after a shared token (position filter) and the 64 oddnesses of slots of
tokens (parity filter). A prefix token that only one set
has is dropped after counting; a bit table of bounded size keeps most of them out of later shuffles.
Each distinct line is first compared with the earliest line of every shared prefix token, which
settles groups of near copies of any size by one comparison a line; only lines not settled so meet
all earlier lines of their tokens. Candidates are verified on the words of their lines, not on
hashes.

Lines without words are never removed. A null text has no lines. Rows with equal id and text count
as one document and get the same answer; rows with one id and several texts are documents of their
own. Rows with a null id are not looked at and lose nothing. Ids may have any type with an order;
extra columns are ignored, or carried along by deduplicate().

Tokens are made in numpy inside Arrow tasks (see the README: the DataFrame form needs more CPU
than its budget); grouping, joins and filters are Spark's. No stage runs Python on what Python made:
each such step has a worker of its own in every task, and idle workers keep their memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import bit_table, discard, in_bit_table, stage, table_bits
from waymark.llm.shingles import WORDS, blocks, distinct, fingerprints, heads_of, mixed, parities, per_segment, prefix_size, rarity_classes, rarity_keys, words_of

#: What names a line: its document's id and text hash, and its number (from 0).
LINE = ["doc_id", "text_hash", "line_no"]
#: Tokens that a task sorts at once, and that a part of them is planned for.
FLUSH, PART = 1 << 20, 1 << 21
#: What names a set of tokens: its fingerprints.
SET = ["f1", "f2"]
#: What the filters look at: tokens in the line, their parity, and where a shared token stands.
FIGURES = ["n", "parity", "pos"]
#: What tells in firsts() whether a line stands for its set: the set's hash, and whether it does so by itself.
LED = ["__key", "__own"]
#: Documents whose lines a task takes apart at once.
SOME = 1000
#: What line numbers are multiplied with in a line's key; products of 31 bits stay longs.
NUMBER = 0x9E3779B1


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash and text of every row with an id and a text."""
    return documents.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def describe(documents: DataFrame) -> DataFrame:
    """LINE, n (distinct tokens), fingerprint (f1, f2), parity and prefix of every line with words."""
    classes = documents.sparkSession.sparkContext.broadcast(rarity_classes(documents, True))  # of fixed size
    names = [*LINE, "n", "f1", "f2", "parity", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, ends in blocks(batch.column(2)):
                words = words_of(data, ends, True)
                segment, tokens = words.tokens()
                segment, keys = distinct(segment, rarity_keys(tokens, classes.value))
                if not keys.size:
                    continue
                lines, first, n = per_segment(segment)
                row = pa.array(words.row[lines] + at)
                figures = [words.number[lines].astype(np.int32), n.astype(np.int32), *fingerprints(keys, first), parities(keys, first, n, 1)[:, 0]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *map(pa.array, figures), heads_of(keys, first, n, prefix_size(n))], names=names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return keyed(documents).mapInArrow(run, f"doc_id {kind}, text_hash long, line_no int, n int, f1 long, f2 long, parity long, prefix array<long>")


def prefix_tokens(lines: DataFrame) -> int:
    """How many prefix tokens the lines (n) have together, by the sizes of their prefixes."""
    return lines.agg(F.sum(F.col("n") - F.ceil(3 * F.col("n") / 4) + 1)).first()[0] or 0


def leading(batches: Iterator[pa.RecordBatch], several: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """With a table of sets, the rows (LED and others) that stand for their set or whose set is not among them, without LED; else all."""
    for batch in batches:
        if several is not None:
            alone = pa.array(~in_bit_table(several.value, batch.column(0).to_numpy()))
            batch = batch.filter(pc.or_(batch.column(1), alone)).select(batch.schema.names[2:])
        yield batch


def shared_tokens(prefixes: DataFrame, total: int, several: Broadcast | None = None) -> DataFrame:
    """token: the tokens of two prefixes (prefix) or more, of `total` tokens at most; with `several`, of the leading() rows of (LED, prefix).

    A task sorts FLUSH tokens at a time and sends each part of them, by hash, as packed numbers:
    those it has once and those it has more often. Parts are as many as the tokens need, so that
    one fits in a task however common some of its tokens are.
    """
    parts = max(1, -(-total // PART))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            part = (mixed(tokens.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            tokens, often, part = tokens[order], counts[order] > 1, part[order]
            names, first = np.unique(part, return_index=True)
            pieces = [(tokens[a:b], often[a:b]) for a, b in zip(first, [*first[1:], part.size], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(names), *(pa.array([t[o == k].tobytes() for t, o in pieces], pa.binary()) for k in (False, True))], names=["part", "once", "often"])

        for batch in leading(batches, several):
            held.append(batch.column(0).flatten().to_numpy())
            if sum(x.size for x in held) >= FLUSH:
                yield flush()
        if sum(x.size for x in held):
            yield flush()

    def merge(rows: pa.Table) -> pa.Table:
        once, often = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int64) for c in ("once", "often"))
        tokens, counts = np.unique(np.concatenate([once, np.unique(often), np.unique(often)]), return_counts=True)
        return pa.table([pa.array(tokens[counts > 1])], names=["token"])

    return prefixes.mapInArrow(pack, "part long, once binary, often binary").groupBy("part").applyInArrow(merge, "token long")


def entries_of(lines: DataFrame, shared: DataFrame, several: Broadcast | None = None) -> DataFrame:
    """LINE, n, parity, pos and token of the prefix tokens that may be among shared (token); with `several`, of the leading() lines."""
    table = lines.sparkSession.sparkContext.broadcast(bit_table(shared, table_bits(shared.count())))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in leading(batches, several):
            flat, sizes = batch.column(5).flatten().to_numpy(), batch.column(5).value_lengths().to_numpy()
            hit = np.flatnonzero(in_bit_table(bits, flat))
            row = np.repeat(np.arange(batch.num_rows), sizes)[hit]
            pos = hit - (np.cumsum(sizes) - sizes)[row]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in range(5)), pa.array(pos.astype(np.int32)), pa.array(flat[hit])], names=[*LINE, *FIGURES, "token"])

    kind = lines.schema["doc_id"].dataType.simpleString()
    return lines.select(*(LED if several is not None else []), *LINE, "n", "parity", "prefix").mapInArrow(run, f"doc_id {kind}, text_hash long, line_no int, n int, parity long, pos int, token long")


def earlier(a: list[str], b: list[str]) -> Column:
    """The line named by the columns a stands before that of b."""
    return F.struct(*a) < F.struct(*(F.col(y).alias(x) for x, y in zip(a, b, strict=True)))


def may_match() -> Column:
    """The length, position and parity filters on FIGURES and, with _0, those of another line.

    Matching sets differ in a seventh of n + n_0 tokens at most, and in as many bits of parity.
    """
    sizes = 4 * F.least("n", "n_0") >= 3 * F.greatest("n", "n_0")
    places = 7 * F.least(F.col("n") - F.col("pos"), F.col("n_0") - F.col("pos_0")) >= 3 * (F.col("n") + F.col("n_0"))
    return sizes & places & (7 * F.bit_count(F.col("parity").bitwiseXOR(F.col("parity_0"))) <= F.col("n") + F.col("n_0"))


def marks(wanted: DataFrame, key: Column) -> Broadcast:
    """A bit table of a key (long) of wanted."""
    return wanted.sparkSession.sparkContext.broadcast(bit_table(wanted.select(key), table_bits(wanted.count())))  # of bounded size


def among(df: DataFrame, table: Broadcast, keys: list[str]) -> DataFrame:
    """The rows of df whose keys' hash may be among those of a table of marks()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.filter(pa.array(in_bit_table(table.value, batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays(there.columns[1:], names=there.schema.names[1:])

    return df.select(F.xxhash64(*keys).alias("__key"), *df.columns).mapInArrow(run, df.schema)


def texts_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """LINE and line of the lines of wanted (LINE), each once."""
    document = F.xxhash64(*LINE[:2])
    texts, lines = marks(wanted, document), marks(wanted, document.bitwiseXOR(F.col("line_no").cast("long") * F.lit(NUMBER)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.filter(pa.array(in_bit_table(texts.value, batch.column(0).to_numpy())))
            for some in (there.slice(k, SOME) for k in range(0, there.num_rows, SOME)):
                split = pc.split_pattern(some.column(3), "\n")
                sizes = split.value_lengths().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(sizes.size), sizes)
                number = np.arange(row.size) - (np.cumsum(sizes) - sizes)[row]
                hit = np.flatnonzero(in_bit_table(lines.value, some.column(0).to_numpy()[row] ^ number * NUMBER))
                at = pa.array(row[hit])
                yield pa.RecordBatch.from_arrays([some.column(1).take(at), some.column(2).take(at), pa.array(number[hit].astype(np.int32)), split.flatten().take(pa.array(hit))], names=[*LINE, "line"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    found = keyed(documents).select(document.alias("__key"), "*").mapInArrow(run, f"doc_id {kind}, text_hash long, line_no int, line string")
    return found.join(wanted, LINE, "left_semi").dropDuplicates(LINE)


def token_set(line: str) -> set[tuple[bytes, ...]]:
    words = line.encode().lower().split()
    return {tuple(words[k : k + WORDS]) for k in range(max(1, len(words) - WORDS + 1))} if words else set()


def verified(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (LINE and, with _0, an earlier line) those that match; each later line once."""
    other = [f"{c}_0" for c in LINE]
    named = lambda cols: F.struct(*(F.col(c).alias(x) for c, x in zip(cols, LINE, strict=True)))
    wanted = stage(pairs.select(F.explode(F.array(named(LINE), named(other))).alias("x")).select("x.*").distinct(), "line-wanted")
    texts = stage(texts_of(documents, wanted), "line-texts")
    both = pairs.join(texts, LINE).join(texts.select(*(F.col(c).alias(f"{c}_0") for c in LINE), F.col("line").alias("other")), other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            found = []
            for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if b != last:  # rows arrive by the earlier line, which often serves many
                    last, held = b, token_set(b)
                own = token_set(a)
                both = len(own & held)
                found.append(4 * both >= 3 * (len(own) + len(held) - both) and both > 0)
            yield batch.filter(pa.array(found, pa.bool_())).select(LINE)

    kind = documents.schema["doc_id"].dataType.simpleString()
    found = stage(both.select(*LINE, "line", "other").mapInArrow(run, f"doc_id {kind}, text_hash long, line_no int").distinct(), "line-matched")
    discard(texts, wanted)
    return found


def near_copies(documents: DataFrame, held: DataFrame) -> DataFrame:
    """LINE of the lines of held (entries_of() one line for each distinct set) that match an earlier one; held is discarded."""
    other = [f"{c}_0" for c in LINE]
    dealt = held.repartition("token")  # the first of a token and its others come from one shuffle
    least = dealt.groupBy("token").agg(F.count("*").alias("df"), F.min(F.struct(*LINE, *FIGURES)).alias("x")).filter("df > 1").select("token", *(F.col(f"x.{c}").alias(f"{c}_0") for c in [*LINE, *FIGURES]))
    led = stage(dealt.join(least.hint("merge"), "token"), "line-led")
    discard(held)
    leaders = stage(led.filter(earlier(other, LINE) & may_match()).select(*LINE, *other).distinct(), "line-pairs")
    settled = verified(documents, leaders)
    open_ = led.select(*LINE, *FIGURES, "token").join(settled, LINE, "left_anti")
    others = led.select("token", *(F.col(c).alias(f"{c}_0") for c in [*LINE, *FIGURES]))
    rest = open_.join(others, "token").filter(earlier(other, LINE) & may_match()).select(*LINE, *other).distinct()
    rest = stage(rest.join(leaders, [*LINE, *other], "left_anti"), "line-pairs")
    discard(led, leaders)
    found = settled.union(verified(documents, rest))
    discard(rest)
    return found


def removed_lines(documents: DataFrame) -> DataFrame:
    """LINE of every line that goes.

    A line whose set an earlier line has goes. Only lines of sets that may have several travel; all
    others are the first of their set where they are. What the later steps do not read is discarded
    before they begin.
    """
    columns = [*LINE, "n", "parity", "prefix"]
    lines = stage(describe(documents), "lines")
    several = stage(lines.groupBy(*SET).agg(F.count("*").alias("lines")).filter("lines > 1").select(*SET), "line-sets")
    table = marks(several, F.xxhash64(*SET))
    often = stage(among(lines.select(*SET, *columns), table, SET), "line-often")
    own = stage(often.groupBy(*SET).agg(F.min(F.struct(*LINE)).alias("x")).select("x.*"), "line-own")
    heads = stage(often.join(own, LINE, "left_semi").dropDuplicates(LINE).select(*SET, *columns), "line-firsts")
    copies = stage(often.select(*LINE).join(own, LINE, "left_anti"), "line-copies")
    discard(several, often, own)

    def firsts(*columns: str) -> DataFrame:
        """LED and columns of all lines and of the first of each common set; the leading() ones are the first of each distinct set."""
        led = lambda df, own: df.select(F.xxhash64(*SET).alias(LED[0]), F.lit(own).alias(LED[1]), *columns)
        return led(lines, False).union(led(heads, True))

    # tokens of one set only cannot make a pair
    shared = stage(shared_tokens(firsts("prefix"), prefix_tokens(lines), table), "line-shared")
    held = stage(entries_of(firsts(*columns), shared, table), "line-tokens")
    discard(lines, heads, shared)
    gone = stage(near_copies(documents, held).union(copies).distinct(), "line-gone")
    discard(copies)
    return gone


def per_document(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (line numbers, comma-joined) of every row."""
    gone = removed_lines(documents).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("line_no")).alias("gone"))
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"))
    return rows.join(gone, ["doc_id", "text_hash"], "left").select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))


def deduplicate(documents: DataFrame) -> DataFrame:
    """The documents without their removed lines, with the same columns; n_chars follows if it is there.

    A document that had words and loses every line with words goes.
    """
    gone = removed_lines(documents).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("__gone")).withColumnRenamed("text_hash", "__hash")
    out = documents.withColumn("__hash", F.xxhash64("text")).join(gone, ["doc_id", "__hash"], "left")
    # a mark for each line up to the last that goes, in time linear in the lines
    before = lambda k: F.coalesce(F.get("__gone", k - 1), F.lit(-1))
    marks = F.flatten(F.transform("__gone", lambda g, k: F.concat(F.array_repeat(F.lit(True), g - before(k) - 1), F.array(F.lit(False)))))
    kept = F.filter(F.zip_with(F.split("text", "\n", -1), marks, lambda line, stays: F.when(F.coalesce(stays, F.lit(True)), line)), lambda line: line.isNotNull())
    out = out.withColumn("text", F.when(F.col("__gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")))
    out = out.filter(F.col("__gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNotNull(), F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)
