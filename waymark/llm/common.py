"""What the training-data operators share: tables, staging and small native helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import ship

#: White space that separates words: the ASCII blanks only.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that sets none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="waymark-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes df once as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/waymark-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.staged_at = path
    return read


def discard(*staged: DataFrame) -> None:
    """Deletes what stage() wrote, once nothing reads it any more."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The maximal runs of characters that are not ASCII blanks; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def bucket_of_id(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text (a null one as no text), modulo folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


#: Bits of a table that prunes, as a power of two: usual and at most; bytes of a block of it.
TABLE_BITS, MOST_TABLE_BITS, TABLE_BLOCK = 24, 28, 1 << 16


def table_bits(values: int) -> int:
    """Bits, as a power of two, for a table with 16 or more a value, up to MOST_TABLE_BITS."""
    return min(MOST_TABLE_BITS, max(20, (16 * values).bit_length()))


def _table_slots(values: np.ndarray, bits: int) -> np.ndarray:
    x = values.view(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(64 - bits)).astype(np.int64)


def bit_table(values: DataFrame, size: int = TABLE_BITS) -> np.ndarray:
    """A table of 2^size bits, however many values there are, with the slots of the first column's (longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros((1 << size) // 8, np.uint8)
        for batch in batches:
            slots = _table_slots(batch.column(0).to_numpy(), size)
            np.bitwise_or.at(packed, slots >> 3, np.uint8(128) >> (slots & 7).astype(np.uint8))
        for k in range(0, packed.size, TABLE_BLOCK):
            if packed[k : k + TABLE_BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([packed[k : k + TABLE_BLOCK].tobytes()], pa.binary())], names=["at", "bits"])

    def merge(key: tuple, part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(TABLE_BLOCK, np.uint8)
        for batch in part:
            for raw in batch.column(batch.schema.get_field_index("bits")).to_pylist():
                bits |= np.frombuffer(raw, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([bits.tobytes()], pa.binary())], names=["at", "bits"])

    out = np.zeros((1 << size) // 8, np.uint8)
    found = values.mapInArrow(run, "at long, bits binary").groupBy("at").applyInArrow(merge, "at long, bits binary").toArrow()  # the table itself, in one job
    for at, bits in zip(found.column(0).to_pylist(), found.column(1), strict=True):
        out[at : at + TABLE_BLOCK] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out


def in_bit_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values (longs) may be among those of the table."""
    slots = _table_slots(values, table.size.bit_length() + 2)
    return (table[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1


class HashedWords(dict):
    """word -> 64-bit hash, remembered for up to `most` words at a time."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def join_labels(df: DataFrame, labels: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """Inner join on doc_id. Labels of at most `most_rows` rows are broadcast; more are shuffled."""
    return df.join(F.broadcast(labels) if labels.count() <= most_rows else labels, "doc_id")


def fit_logistic(x, y, ridge: float = 1e-3, steps: int = 50):
    """Weights and bias of a ridge logistic regression, by Newton's method in numpy."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.r_[np.full(x.shape[1] - 1, ridge * len(x)), 1e-9]
        change = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= change
        if np.abs(change).max() < 1e-8:
            break
    return w[:-1], w[-1]
