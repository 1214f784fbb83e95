"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each piece that the split pattern yields is merged on its own. A segment tree over its byte
positions holds, at each live position, the rank of the pair that starts there; its root is the
smallest rank and descending left first finds the leftmost such pair. A merge changes three
positions: the pair itself, the neighbour that dies, and the live neighbour before it.

Texts that are null count as empty; an empty text has no ids. Pieces of any length cost
n log n steps. Extra columns are dropped except those named in `keep`.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.session import ship

NONE = 1 << 60
#: Rows that one step holds in memory at a time.
STEP = 500
#: The characters with Unicode's White_Space property, which the split pattern's \s stands for.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")


class Merger:
    """The merge table of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        #: chunk -> its ids as int32 bytes
        self.known: dict[str, bytes] = {}

    @cached_property
    def pairs(self) -> dict[int, int]:
        """(left id, right id) -> id of the two joined, for every split of every token."""
        ranks = self.ranks
        return {(ranks[t[:k]] << 32) | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.single[b] for b in piece]
        n, pairs = len(ids), self.pairs
        if n < 2:
            return ids
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = pairs.get(ids[i] << 32 | ids[i + 1], NONE)
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a <= b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, rank: int) -> None:
            k = size + i
            tree[k] = rank
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a <= b else b
                if tree[k] == low:
                    return
                tree[k] = low

        while (best := tree[1]) != NONE:
            k = 1
            while k < size:
                k *= 2
                if tree[k] != best:
                    k += 1
            i = k - size
            j = after[i]
            ids[i] = best  # the rank of a pair is the id of what it makes
            nxt = after[i] = after[j]
            ids[j] = -1
            if nxt < n:
                before[nxt] = i
            if j < n - 1:
                put(j, NONE)
            put(i, pairs.get(best << 32 | ids[nxt], NONE) if nxt < n else NONE)
            prev = before[i]
            if prev >= 0:
                put(prev, pairs.get(ids[prev] << 32 | best, NONE))
        return [x for x in ids if x >= 0]

    @cached_property
    def probe(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs as an open-addressing table: keys (-1 where free) and ranks."""
        bits = (4 * len(self.pairs)).bit_length()
        keys, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        left, lrank = np.fromiter(self.pairs, np.int64, len(self.pairs)), np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
        at = self._slot(left, bits)
        while left.size:
            free = keys[at] < 0
            _, first = np.unique(at, return_index=True)
            won = np.zeros(left.size, bool)
            won[first] = True
            won &= free
            keys[at[won]], ranks[at[won]] = left[won], lrank[won]
            left, lrank, at = left[~won], lrank[~won], (at[~won] + 1) & ((1 << bits) - 1)
        return keys, ranks

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NONE where they don't merge or either is dead (-1)."""
        keys, ranks = self.probe
        mask, want = keys.size - 1, (a << 32) | b
        at = self._slot(want, keys.size.bit_length() - 1)
        out, open_ = np.full(want.size, NONE, np.int64), np.flatnonzero((a >= 0) & (b >= 0))
        while open_.size:
            found = keys[at[open_]]
            hit = found == want[open_]
            out[open_[hit]] = ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            at[open_] = (at[open_] + 1) & mask
        return out

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """merge() for many pieces at once: one segment tree a row, all rows advance together."""
        out: list[list[int]] = [[]] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = [whole]
            elif len(piece) > 64:
                out[k] = self.merge(piece)
            else:
                by_size.setdefault(1 << (len(piece) - 1).bit_length(), []).append(k)
        for size, members in by_size.items():
            for start in range(0, len(members), 4096):
                some = members[start : start + 4096]
                for k, ids in zip(some, self._merge_rows([pieces[k] for k in some], size), strict=True):
                    out[k] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], size: int) -> list[list[int]]:
        rows = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, rows)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(rows, size)
        cols = np.arange(size)
        # column `size` stands for what lies outside the piece
        ids = np.full((rows, size + 1), -1, np.int64)
        ids[:, :size] = np.where(cols < lens[:, None], np.asarray(self.single, np.int64)[raw], -1)
        after = np.minimum(np.tile(np.arange(1, size + 2), (rows, 1)), size)
        after = np.where(after < lens[:, None], after, size)
        before = np.tile(np.r_[size, np.arange(size)], (rows, 1))
        before[:, size] = size
        tree = np.full((rows, 2 * size), NONE, np.int64)
        tree[:, size:] = self.ranks_of(ids[:, :size].ravel(), np.take_along_axis(ids, after[:, :size], 1).ravel()).reshape(rows, size)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])

        def put(r: np.ndarray, i: np.ndarray, rank: np.ndarray | int) -> None:
            k = size + i
            tree[r, k] = rank
            for _ in range(size.bit_length() - 1):
                k = k >> 1
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

        live = np.flatnonzero(tree[:, 1] != NONE)
        while live.size:
            best, k = tree[live, 1], np.ones(live.size, np.int64)
            for _ in range(size.bit_length() - 1):
                k = 2 * k
                k += tree[live, k] != best
            i = k - size
            j = after[live, i]
            nxt, prev = after[live, j], before[live, i]
            ids[live, i], ids[live, j] = best, -1
            after[live, i], before[live, nxt] = nxt, i
            put(live, j, NONE)
            put(live, i, self.ranks_of(best, ids[live, nxt]))
            some = prev < size
            r, p = live[some], prev[some]
            put(r, p, self.ranks_of(ids[r, p], best[some]))
            live = live[tree[live, 1] != NONE]
        return [[x for x in row if x >= 0] for row in ids[:, :size].tolist()]

    def encode_batch(self, texts: list[str | None], most_known: int = 125_000, longest_known: int = 48) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids begin.

        No piece runs from a non-blank into a blank, so a text falls into chunks (blanks, then
        non-blanks) that encode each on its own. Short chunks are remembered, at most
        `most_known` at a time.
        """
        if len(self.known) > most_known:
            self.known.clear()
        known, long = self.known, []
        chunked = [CHUNKS.findall(t) if t else [] for t in texts]
        new = {c for chunks in chunked for c in chunks if c not in known}
        split = {c: self.pattern.findall(c) for c in new}
        pieces = list({p for found in split.values() for p in found})
        merged = {p: np.array(ids, np.int32).tobytes() for p, ids in zip(pieces, self.merge_many([p.encode() for p in pieces]), strict=True)}
        for c, found in split.items():
            known[c] = merged[found[0]] if len(found) == 1 else b"".join([merged[p] for p in found])
            if len(c) > longest_known:
                long.append(c)
        parts = [b"".join(map(known.__getitem__, chunks)) for chunks in chunked]
        for c in long:
            del known[c]
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(p) // 4 for p in parts], out=starts[1:])
        return np.frombuffer(b"".join(parts), np.int32), starts

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes in a row, and each token's place and length there."""
        names = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        lens = np.fromiter(map(len, names), np.int64, len(names))
        return np.frombuffer(b"".join(names), np.uint8), np.cumsum(lens) - lens, lens

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and how many of them each id makes."""
        spelled, at, lens = self.spelled
        n = lens[ids]
        ends = np.cumsum(n)
        return spelled[np.repeat(at[ids] - ends + n, n) + np.arange(ends[-1] if ids.size else 0)], n

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_flat(np.asarray(ids, np.int64))[0].tobytes()


@lru_cache(maxsize=4)
def merger(path: str, pattern: str) -> Merger:
    """One table per Python worker; the vocabulary is read where the tokenizer package is installed."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return Merger(ranks, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _located(path: str) -> str:
    """The same file of the tokenizer package on this machine, should it be installed elsewhere."""
    if not os.path.exists(path):
        import public_tokenizers

        return public_tokenizers.path(os.path.basename(path))
    return path


def encode(df: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """`keep` columns and ids array<int>."""
    path, default = default_vocabulary()
    path, pattern = vocabulary or path, pattern or default

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(_located(path), pattern)
        for batch in batches:
            for some in (batch.slice(k, STEP) for k in range(0, batch.num_rows, STEP)):
                ids, starts = m.encode_batch(some.column(len(keep)).to_pylist())
                lists = pa.LargeListArray.from_arrays(starts, pa.array(ids)).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], lists], names=[*keep, "ids"])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    ship(df.sparkSession)
    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, keep: list[str], ids_col: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """`keep` columns, the ids and `decoded` binary; null ids give null."""
    path, default = default_vocabulary()
    path, pattern = vocabulary or path, pattern or default

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(_located(path), pattern)
        for batch in batches:
            for some in (batch.slice(k, STEP) for k in range(0, batch.num_rows, STEP)):
                lists = some.column(len(keep))
                flat, sizes = m.decode_flat(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                per_list = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(per_list)]]
                raw = flat.tobytes()
                decoded = [raw[a:b] if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), lists.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(decoded, pa.binary())], names=[*keep, ids_col, "decoded"])

    schema = T.StructType([*(df.schema[c] for c in keep), df.schema[ids_col], T.StructField("decoded", T.BinaryType())])
    ship(df.sparkSession)
    return df.select(*keep, ids_col).mapInArrow(run, schema)


def round_trip(df: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """`keep` columns, ids and `decoded`, as decode(encode()) gives them, by one Python worker a task."""
    path, default = default_vocabulary()
    path, pattern = vocabulary or path, pattern or default

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(_located(path), pattern)
        for batch in batches:
            for some in (batch.slice(k, STEP) for k in range(0, batch.num_rows, STEP)):
                ids, starts = m.encode_batch(some.column(len(keep)).to_pylist())
                flat, sizes = m.decode_flat(ids.astype(np.int64))
                raw, ends = flat.tobytes(), np.r_[0, np.cumsum(sizes)][starts].tolist()
                decoded = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                lists = pa.LargeListArray.from_arrays(starts, pa.array(ids)).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], lists, pa.array(decoded, pa.binary())], names=[*keep, "ids", "decoded"])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    ship(df.sparkSession)
    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def digests(df: DataFrame, keep: list[str]) -> DataFrame:
    """n_tokens and the hashes of ids and decoded bytes, of what encode() and decode() return."""
    return df.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
