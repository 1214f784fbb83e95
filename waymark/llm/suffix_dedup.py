"""Removal of repeated byte strings by longest previous factors.

Texts are UTF-8 bytes; a match is a string of `length` bytes that starts at two places, of one
document or of two, and never runs over the end of a text. Places are ordered by doc_id (null
first), text hash and offset. A place whose longest previous factor, the longest string there that
also starts at an earlier place, has `length` bytes or more begins a later copy; the place that
factor comes from begins an earlier one. Together these are all places of all strings that repeat.

1. Every window of `length` bytes is filed under its anchor: the run of GRAM bytes in it whose hash
   is smallest, the leftmost of equal ones. Equal windows have equal anchors. Neighbouring windows
   with one anchor form a segment of about 275 bytes. Anchor and segment travel as hashes.
2. Equal segments become one class, by an aggregate with partial sums: all windows of a class of
   two or more repeat, and only its first segment goes on. An anchor with one class is done.
3. The first segments of all other classes are fetched, and dealt by anchor into blocks of some
   BLOCK bytes. A block's suffix order comes from doubling ranks in numpy; the previous and the
   next smaller place in it give the longest previous factors. The order is cut at CAP bytes, which
   is more than a match needs.
4. An anchor with more than MOST classes (where a passage that many share meets what stands beside
   it) is never one group. Its segments are cut into pieces of WIDTHS[0] neighbouring windows, filed
   under the bytes that all windows of a piece have, and go through steps 2 and 3 again; a piece
   that is still too common goes on with the next smaller width. At width 1 equal pieces are equal
   windows, and step 2 settles them.

Step 2 compares 64-bit hashes under a 64-bit anchor. Nothing is capped: every window of every text
goes one of these ways.

Null texts are empty. Rows that agree in id and text are places of their own and repeat each other;
with keep_first they count as one document. Null ids, repeated ids and other columns are allowed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import discard, stage
from waymark.llm.shingles import SOME, _powers, blocks, mixed
from waymark.session import ship

LENGTH, GRAM = 200, 48
#: Bytes of segments in a block; classes of an anchor in a block; bytes that the suffix order looks at.
BLOCK, MOST, CAP = 1 << 18, 500, 256
#: Windows in the pieces of a segment whose anchor is too common, one width after another.
WIDTHS = (16, 4, 1)
DOC = ["doc_id", "text_hash"]


def smallest_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of the `width` values from each place on, for all places that have so many."""
    n = values.size - width + 1
    rows = -(-values.size // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: values.size] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """Of texts that lie one after another, each segment's text, first and last window and anchor (places in data), and the hashes of anchor and segment."""
    begins = np.r_[0, ends[:-1]]
    sizes = np.maximum(ends - begins - length + 1, 0)  # windows of each text
    if not sizes.sum():
        return [np.zeros(0, np.int64)] * 6
    powers, shrink = _powers(1 << max(20, int(data.size).bit_length()))
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: data.size], out=sums[1:])
    grams = mixed((sums[gram:] - sums[:-gram]) * shrink[: data.size - gram + 1])
    bits = np.uint64(int(data.size).bit_length())
    packed = (grams >> bits << bits) | np.arange(grams.size, dtype=np.uint64)  # leftmost on ties
    at = (smallest_ahead(packed, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(ends.size), sizes)
    window = np.arange(text.size) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[text]
    anchor = at[window]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    lo, hi = window[new], window[np.r_[new[1:], window.size] - 1]
    whole = mixed((sums[hi + length] - sums[lo]) * shrink[lo] + (hi - lo).astype(np.uint64))
    return [text[new], lo, hi, anchor[new], grams[anchor[new]].view(np.int64), whole.view(np.int64)]


def keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def filed(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """DOC, lo, hi (first and last window), at (where the anchor starts), anchor and segment (hashes) of every segment."""

    def rows(batch: pa.RecordBatch, row: np.ndarray, places: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
        owner = pa.array(row)
        return pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *(pa.array(x.astype(np.int32)) for x in places), *map(pa.array, hashes)], names=[*DOC, "lo", "hi", "at", "anchor", "segment"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, ends in blocks(batch.column(2)):
                begins = np.r_[0, ends[:-1]]
                if ends.size > 1 or data.size <= 2 * SOME:
                    text, *places, anchor, whole = segments(data, ends, length)
                    yield rows(batch, text + first, [x - begins[text] for x in places], [anchor, whole])
                    continue
                for k in range(0, data.size, SOME):  # a very long text, in parts that share all but the windows
                    part = data[k : k + SOME + length - 1]
                    text, *places, anchor, whole = segments(part, np.array([part.size]), length)
                    yield rows(batch, text + first, [x + k for x in places], [anchor, whole])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return keyed(documents).filter(F.octet_length("text") >= length).mapInArrow(run, f"doc_id {kind}, text_hash long, lo int, hi int, at int, anchor long, segment long")


def smaller_before(x: np.ndarray) -> np.ndarray:
    """Where the nearest smaller value before each one stands, -1 without; values differ."""
    p = np.arange(x.size) - 1
    left = np.flatnonzero(p >= 0)
    while (left := left[x[p[left]] > x[left]]).size:
        p[left] = p[p[left]]  # all between that one and the next candidate are larger still
        left = left[p[left] >= 0]
    return p


class Suffixes:
    """Ranks of all suffixes of a block by their first 8, 16, ... CAP bytes."""

    def __init__(self, data: np.ndarray):
        n = data.size
        padded = np.zeros(n + 8, np.uint64)
        padded[:n] = data
        self.words = []  # the first 1, 2 and 4 bytes as they are
        step, key = 1, padded
        while step < 8:
            self.words.append((step, key[:n]))
            key = key[: key.size - step] << np.uint64(8 * step) | key[step:]
            step *= 2
        self.ranks: list[tuple[int, np.ndarray]] = []
        rank = self._dense(key[:n])
        while True:
            self.ranks.append((step, rank))
            if step >= CAP:
                break
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = rank[step:] + 1
            rank = self._dense(rank * np.int64(n + 1) + after)
            step *= 2

    @staticmethod
    def _dense(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        ordered = keys[order]
        out = np.empty(keys.size, np.int64)
        out[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b share from their start on, CAP at most; -1 where b is none."""
        n = self.ranks[0][1].size
        out = np.zeros(a.size, np.int64)
        for step, rank in [*self.ranks[::-1], *self.words[::-1]]:
            x, y = a + out, b + out
            inside = (np.maximum(x, y) < n) & (out < CAP)
            same = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
            out += np.where(same, step, 0)
        return np.where(b < 0, -1, out)


def previous_factors(data: np.ndarray, starts: np.ndarray, place: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start, the length of its longest previous factor (CAP at most) and which start that comes from, -1 without.

    place: the starts' order in the whole corpus; rest: bytes from a start to the end of its segment.
    """
    suffixes = Suffixes(data)
    order = np.lexsort((place, suffixes.ranks[-1][1][starts]))
    x = place[order]
    before = smaller_before(x)
    after = x.size - 1 - smaller_before(x[::-1])[::-1]
    after[after == x.size] = -1
    best, source = np.full(x.size, -1), np.full(x.size, -1)
    for other in (before, after):
        there = other >= 0
        own, far = order[there], order[other[there]]
        shared = np.minimum(suffixes.common(starts[own], starts[far]), np.minimum(rest[own], rest[far]))
        better = shared > best[own]
        best[own[better]], source[own[better]] = shared[better], far[better]
    return best, source


def factored(wanted: DataFrame, length: int) -> DataFrame:
    """DOC, start, stop and later of what repeats among segments (DOC, lo, hi, segment, bytes, block); later: an earlier place has it too."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in (*DOC, "lo", "segment")], null_placement="at_start"))
        # rows that agree in id and text brought the one segment of a class twice
        names = [table.column(c).to_numpy() for c in ("text_hash", "lo", "segment")]
        table = table.filter(pa.array(np.r_[True, np.any([x[1:] != x[:-1] for x in names], axis=0)]))
        lo, hi = (table.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
        raw = table.column("bytes").combine_chunks().to_pylist()
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = hi - lo + 1
        begin = np.cumsum(size + length - 1) - (size + length - 1)
        row = np.repeat(np.arange(size.size), size)
        offset = np.arange(row.size) - np.repeat(np.cumsum(size) - size, size)
        starts = begin[row] + offset
        best, source = previous_factors(data, starts, np.arange(row.size), (size + length - 1)[row] - offset)
        later = best >= length
        repeats = later.copy()
        repeats[source[later]] = True
        state = repeats.astype(np.int8) + later
        new = np.flatnonzero(np.r_[True, (state[1:] != state[:-1]) | (row[1:] != row[:-1])])
        last = np.r_[new[1:], row.size] - 1
        new, last = new[state[new] > 0], last[state[new] > 0]
        owner = pa.array(row[new])
        start, stop = lo[row[new]] + offset[new], lo[row[new]] + offset[last] + length
        return pa.table([table.column("doc_id").take(owner), table.column("text_hash").take(owner), pa.array(start), pa.array(stop), pa.array(state[new] == 2)], names=[*DOC, "start", "stop", "later"])

    kind = wanted.schema["doc_id"].dataType.simpleString()
    return wanted.groupBy("block").applyInArrow(run, f"doc_id {kind}, text_hash long, start long, stop long, later boolean")


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def fetched(documents: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (DOC, lo, hi, anchor and more) with the bytes of its segments."""
    own = [c for c in wanted.columns if c not in DOC]
    per_document = wanted.groupBy(*DOC).agg(F.collect_list(F.struct(*own)).alias("__wanted"))  # as many as a text has
    texts = keyed(documents).filter(F.octet_length("text") >= length)
    both = texts.join(per_document, same_document(texts, per_document)).select(texts["doc_id"], texts["text_hash"], F.col("text").cast("binary").alias("__raw"), "__wanted")
    cut = F.transform("__wanted", lambda w: F.struct(*(w[c].alias(c) for c in own), F.substring(F.col("__raw"), w["lo"] + 1, w["hi"] - w["lo"] + length).alias("bytes")))
    return both.select(*DOC, F.explode(cut).alias("x")).select(*DOC, "x.*")


def narrower(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """Pieces (DOC, lo, hi, at, anchor, segment, bytes) cut into pieces of `width` windows at most.

    Windows are dealt by their distance from the anchor, so that equal windows come into pieces of
    one name: the old anchor, the distance and the bytes that every window of such a piece has.
    """
    low, high = F.floor((F.col("at") - F.col("hi")) / width), F.floor((F.col("at") - F.col("lo")) / width)

    def one(k: Column) -> Column:
        last = F.col("at") - k * width  # the last window of the piece, were it whole
        lo, hi = F.greatest(F.col("lo"), last - width + 1).cast("int"), F.least(F.col("hi"), last).cast("int")
        of = lambda start, size: F.substring(F.col("bytes"), (start - F.col("lo") + 1).cast("int"), F.lit(size) if isinstance(size, int) else size.cast("int"))
        raw = of(lo, hi - lo + length)
        return F.struct(lo.alias("lo"), hi.alias("hi"), "at", F.xxhash64("anchor", k, of(last, length - width + 1)).alias("anchor"), F.xxhash64(F.col("at") - lo, raw).alias("segment"), raw.alias("bytes"))

    return pieces.select(*DOC, F.explode(F.transform(F.sequence(low, high), one)).alias("x")).select(*DOC, "x.*")


def in_classes(pieces: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(what repeats as a whole: DOC, start, stop, later; the first piece of every class of anchors with several, staged)."""
    place = F.struct(*DOC, "lo", "hi", "at")
    classes = stage(pieces.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(place).alias("first")), "segment-classes")
    copies = pieces.join(classes.filter("n > 1").select("anchor", "segment", "first"), ["anchor", "segment"])
    equal = copies.select(*DOC, F.col("lo").cast("long").alias("start"), (F.col("hi") + length).cast("long").alias("stop"), (~place.eqNullSafe(F.col("first"))).alias("later"))
    sizes = classes.groupBy("anchor").agg(F.count("*").alias("classes")).filter("classes > 1")
    wanted = stage(classes.join(sizes, "anchor").select("first.*", "anchor", "segment", "classes"), "segment-firsts")
    found = stage(equal, "segment-copies")
    discard(classes)
    return found, wanted


def repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """DOC, start, stop and later: bytes covered by strings of `length` that start elsewhere too; rows may overlap."""
    ship(documents.sparkSession)
    pieces, found, done = stage(filed(documents, length), "segments"), [], []
    for width in (*WIDTHS, None):
        equal, wanted = in_classes(pieces, length)
        found.append(equal)
        done += [pieces, wanted, equal]
        if "bytes" in pieces.columns:
            held = wanted.join(pieces.select(*DOC, "lo", "anchor", "segment", "bytes").withColumnsRenamed({c: f"{c}_0" for c in (*DOC, "lo")}), ["anchor", "segment"])
            same = F.col("doc_id").eqNullSafe(F.col("doc_id_0")) & (F.col("text_hash") == F.col("text_hash_0")) & (F.col("lo") == F.col("lo_0"))
            held = held.filter(same).select(*wanted.columns, "bytes")
        else:
            held = fetched(documents, wanted, length)
        held = stage(held, "segment-bytes")
        done.append(held)
        usual = held.filter(F.col("classes") <= MOST)
        total = usual.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
        block = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-total // BLOCK))))
        found.append(factored(usual.withColumn("block", block).drop("classes", "anchor", "at"), length))
        common = held.filter(F.col("classes") > MOST)
        if width is None or common.isEmpty():
            break
        pieces = stage(narrower(common, width, length), "segments")
    out = stage(reduce(DataFrame.union, found), "repeats")
    discard(*done)
    return out


def with_spans(documents: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """The documents, all columns, with `spans`: struct(start, stop) of the bytes to remove, ascending, maybe overlapping.

    keep_first spares what has no earlier copy.
    """
    found = repeats(documents, length)
    if keep_first:
        found = found.filter("later")
    per_document = found.groupBy(*DOC).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    rows = documents.withColumn("__hash", F.xxhash64("text"))
    here = rows["doc_id"].eqNullSafe(per_document["doc_id"]) & (rows["__hash"] == per_document["text_hash"])
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return rows.join(per_document, here, "left").select(*(rows[c] for c in documents.columns), F.coalesce("spans", none).alias("spans"))


def merged(spans: pa.ListScalar) -> list[tuple[int, int]]:
    """Maximal runs of ascending, maybe overlapping spans."""
    out: list[tuple[int, int]] = []
    for span in spans.as_py() or ():
        if out and span["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], span["stop"]))
        else:
            out.append((span["start"], span["stop"]))
    return out


def removed(documents: DataFrame, keep: list[str], length: int = LENGTH, keep_first: bool = False, kept: bool = True) -> DataFrame:
    """`keep`, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the bytes that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, spans in zip(batch.column(len(keep)).cast(pa.binary()), batch.column(len(keep) + 1), strict=True):
                raw, gone = text.as_py() or b"", merged(spans)
                left = b"".join(raw[a:b] for a, b in zip([0, *(y for _, y in gone)], [*(x for x, _ in gone), len(raw)], strict=True)) if gone else raw
                for column, value in zip(out, (len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)][: 5 if kept else 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=names)

    names = [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if kept else [])]
    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept
    rows = with_spans(documents, length, keep_first)
    return rows.select(*keep, "text", "spans").mapInArrow(run, schema)
