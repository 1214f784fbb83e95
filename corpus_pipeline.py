"""The corpus pipeline: five stages from raw documents to tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bpe, decontamination, jaccard_join, kn_toxicity, line_dedup
from waymark.llm.common import discard, stage, table
from waymark.session import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the Kneser-Ney models find toxic."""
    model = kn_toxicity.fit(docs, table(spark, sf_dir, "labels"), kn_toxicity.learnable())
    return kn_toxicity.keep_clean(docs, model)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every line that matches an earlier one; documents left without a word go."""
    return line_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, keeps that with the smallest id."""
    others = jaccard_join.link(docs).filter("component_id <> doc_id").select("doc_id")
    return docs.join(others.distinct(), "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose tiles cover half of a test item or more."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text, decodes the ids, and returns their number and hashes."""
    ship(spark)
    return bpe.digests(bpe.round_trip(docs, ["doc_id"]), ["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Trained models and byte-pair merges are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-"))
            if last is not None:  # all of it has been read
                discard(last)
            last = docs
    return docs
