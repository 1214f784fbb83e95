"""Word shingles of many texts at once, in numpy over the bytes of an Arrow column.

A text's words are its maximal runs of bytes other than ASCII blanks, with A-Z lower-cased; a
segment is a whole text or one of its lines. Its tokens are 64-bit hashes of its runs of `words`
words, or of its whole word sequence if it has fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.session import ship

WORDS = 5
#: Slots of the table of token counts, and of a block of it.
RARITY_BITS, RARITY_BLOCK = 20, 1 << 14
MIX = np.uint64(0xFF51AFD7ED558CCD)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are looked at together; a longer text is looked at alone.
SOME = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x)], dtype=np.uint64) for x in (BASE, inverse))


@dataclass
class Words:
    """Words of `segments` segments: each one's hash, its segment (ascending); each segment's row and its number there."""

    hashes: np.ndarray
    segment: np.ndarray
    row: np.ndarray
    number: np.ndarray

    def tokens(self, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Segment and token of every shingle; a token may repeat in its segment."""
        h, seg = self.hashes, self.segment
        sizes = np.bincount(seg, minlength=self.row.size)

        def joined(first: np.ndarray, k: int) -> np.ndarray:
            out = np.full(first.size, k, np.uint64)
            for j in range(k):
                out = mixed(out * np.uint64(0x100000001B3) + h[first + j])
            return out

        starts = np.flatnonzero(seg[words - 1 :] == seg[: h.size - words + 1]) if h.size >= words else np.zeros(0, np.int64)
        segs, tokens = [seg[starts]], [joined(starts, words)]
        first = np.cumsum(sizes) - sizes
        for k in range(1, words):
            few = np.flatnonzero(sizes == k)
            if few.size:
                segs.append(few)
                tokens.append(joined(first[few], k))
        return np.concatenate(segs), np.concatenate(tokens)


def words_of(data: np.ndarray, ends: np.ndarray, by_line: bool) -> Words:
    """The words of texts that lie one after another in data; ends: where each ends."""
    data = np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)
    there = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = np.r_[0, ends[:-1]].astype(np.int64)
    before, after = np.r_[False, there[:-1]], np.r_[there[1:], False]
    inner = begins[(begins > 0) & (begins < data.size)]
    before[inner] = False
    after[inner - 1] = False
    start, stop = np.flatnonzero(there & ~before), np.flatnonzero(there & ~after) + 1
    powers, shrink = _powers(1 << max(20, int(data.size).bit_length()))
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: data.size], out=sums[1:])
    hashes = mixed((sums[stop] - sums[start]) * shrink[start] + (stop - start).astype(np.uint64))
    if by_line:
        breaks = np.flatnonzero(data == 10)
        owner = np.searchsorted(ends, breaks, "right")
        lines = np.bincount(owner, minlength=ends.size) + 1
        row = np.repeat(np.arange(ends.size), lines)
        first = np.cumsum(lines) - lines
        number = np.arange(row.size) - first[row]
        segment = np.searchsorted(ends, start, "right") + np.searchsorted(breaks, start)
    else:
        row, number = np.arange(ends.size), np.zeros(ends.size, np.int64)
        segment = np.searchsorted(ends, start, "right")
    return Words(hashes, segment, row, number)


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, where each text ends) of runs of rows with some SOME bytes; null texts are empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SOME, "right")) - 1)
        to = min(to, len(column))
        yield at, raw[offsets[at] : offsets[to]], (offsets[at + 1 : to + 1] - offsets[at]).astype(np.int64)
        at = to


def distinct(segment: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments and their distinct keys, in order; the segments given may be in any order."""
    order = np.argsort(keys)
    few = segment.astype(np.uint16) if segment.size and segment.max() < 1 << 16 else segment  # these sort faster
    order = order[np.argsort(few[order], kind="stable")]
    segment, keys = segment[order], keys[order]
    new = np.ones(keys.size, bool)
    new[1:] = (segment[1:] != segment[:-1]) | (keys[1:] != keys[:-1])
    return segment[new], keys[new]


def per_segment(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ascending segments: those there are, where each begins, and how many entries each has."""
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if segment.size else np.zeros(0, np.int64)
    return segment[first], first, np.diff(np.r_[first, segment.size])


def fingerprints(keys: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over the mixed keys of each segment: equal for equal sets."""
    return [np.add.reduceat(mixed(keys ^ np.uint64(x)), first).view(np.int64) for x in (0x1234567, 0xC2B2AE3D27D4EB4F)]


def parities(keys: np.ndarray, first: np.ndarray, n: np.ndarray, longs: int) -> np.ndarray:
    """`longs` columns of bits for each segment, each bit the oddness of a slot's number of keys."""
    slots = (mixed(keys ^ MIX) % np.uint64(64 * longs)).astype(np.int64) + 64 * longs * np.repeat(np.arange(n.size), n)
    odd = (np.bincount(slots, minlength=64 * longs * n.size) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n.size, longs)


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Sets of a Jaccard similarity of 0.75 share a token among the first so many of n, in any order of all tokens."""
    return n - -(-3 * n // 4) + 1


def heads_of(keys: np.ndarray, first: np.ndarray, n: np.ndarray, size: np.ndarray) -> pa.ListArray:
    """The first `size` keys of each segment."""
    kept = np.arange(keys.size) - np.repeat(first, n) < np.repeat(size, n)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(keys[kept].view(np.int64)))


def rarity_classes(documents: DataFrame, by_line: bool) -> np.ndarray:
    """A class for each token slot, higher the commoner it is, by counts over all documents.

    Blocks of counts travel, of a fixed size a task. Large counts order by their logarithm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, np.int32)
        for batch in batches:
            for _, data, ends in blocks(batch.column(0)):
                slots = words_of(data, ends, by_line).tokens()[1] >> np.uint64(64 - RARITY_BITS)
                total += np.bincount(slots.astype(np.int64), minlength=total.size).astype(np.int32)
        for k in range(0, total.size, RARITY_BLOCK):
            block = total[k : k + RARITY_BLOCK]
            if block.any():
                small = block.astype(np.uint8) if block.max() < 256 else block
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([small.tobytes()], pa.binary())], names=["at", "counts"])

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY_BLOCK, np.int64)
        for part in parts:
            for raw in part.column(part.schema.get_field_index("counts")).to_pylist():
                total += np.frombuffer(raw, np.uint8 if len(raw) == RARITY_BLOCK else np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], names=["at", "counts"])

    ship(documents.sparkSession)
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    found = documents.select("text").mapInArrow(run, "at long, counts binary").groupBy("at").applyInArrow(merge, "at long, counts binary").toArrow()  # of fixed size, in one job
    for at, raw in zip(found.column(0).to_pylist(), found.column(1), strict=True):
        counts[at : at + RARITY_BLOCK] = np.frombuffer(raw.as_buffer(), np.int64)
    return np.round(8 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def rarity_keys(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Tokens as keys that order by rarity and then by hash; the hash's last byte gives way to the class."""
    return classes[(tokens >> np.uint64(64 - RARITY_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | tokens >> np.uint64(8)
