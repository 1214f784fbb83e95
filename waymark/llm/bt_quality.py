"""Quality by Bradley-Terry ranking: a linear score learnt from preference pairs.

Each document is described by figures of its whole text (shares of character kinds, repetition
of words, word runs and lines, word lengths). From labelled documents come preference pairs
(a good one, a bad one); the weights minimise the logistic loss on the pairs' feature
differences, which is the Bradley-Terry likelihood of the good one winning. The cut is the
quantile of the training scores at the share of bad labels; a logistic scale places it at the
wanted score, so that scores lie between 0 and 1 and rise with the ranking.

Null and empty texts get the figures of a text without words, and a score like any other. Equal
texts get equal scores. Without labels of both kinds every score is 1, and nothing is rejected.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import bucket_of_id, join_labels, stage
from waymark.session import ship

FEATURES = ["log_words", "word_chars", "upper", "digit", "symbol", "marks", "blank", "high", "lone", "distinct", "top_word", "twins", "runs3", "runs10", "dup_lines", "line_words", "capital_words", "end_marks"]
KIND = np.zeros(256, np.int64)  # 0 lower-case and other letters
for _kind, _chars in ((1, range(65, 91)), (2, range(48, 58)), (3, b"#*$%&|<>"), (4, b"!?.,;:'\"()[]-_/\\=+@^`~{}"), (5, b" \t\n\r\x0b\x0c"), (6, range(128, 256))):
    KIND[list(_chars)] = _kind


def figures(text: str | None) -> list[float]:
    """The figures of one text, in the order of FEATURES."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(KIND[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    lens = np.fromiter(map(len, ids), np.int64, len(ids))[seq]
    counts = np.bincount(seq)

    def repeated(k: int) -> float:
        """The share of k-word runs that occur again."""
        if n < k + 1:
            return 0.0
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h = (h ^ seq[j : n - k + 1 + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return 1 - np.unique(h).size / h.size

    lines = Counter(x for x in raw.split(b"\n") if x.strip())
    n_lines = sum(lines.values())
    return [
        math.log1p(n), min(lens.mean(), 40.0), *kinds[1:].tolist(), (lens == 1).mean(), len(ids) / n, counts.max() / n,
        float((seq[1:] == seq[:-1]).mean()) if n > 1 else 0.0, repeated(3), repeated(10), 1 - len(lines) / n_lines, math.log1p(n / n_lines),
        sum(c for w, c in zip(ids, counts.tolist(), strict=True) if w.isupper()) / n, sum(c for w, c in zip(ids, counts.tolist(), strict=True) if w[-1] in b"!#*$%&|") / n,
    ]


def describe(documents: DataFrame) -> DataFrame:
    """doc_id and FEATURES of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([figures(t) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], names=["doc_id", *FEATURES])

    kind = documents.schema["doc_id"].dataType.simpleString()
    ship(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in FEATURES))


@dataclass
class Ranking:
    weights: np.ndarray
    cut: float
    spread: float


def learn(x: np.ndarray, good: np.ndarray, pairs_per_bad: int = 40, ridge: float = 1e-3, steps: int = 40, seed: int = 7) -> Ranking | None:
    """Weights from pairs of a good and a bad row; each bad row meets `pairs_per_bad` good ones."""
    wins, losses = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not wins.size or not losses.size:
        return None
    scale = x.std(0) + 1e-9
    z = x / scale
    pick = np.random.default_rng(seed)
    loser = np.repeat(losses, pairs_per_bad)
    d = z[pick.choice(wins, loser.size)] - z[loser]
    w = np.zeros(z.shape[1])
    for _ in range(steps):  # Newton steps on the mean of log(1 + exp(-w d))
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p) + 1e-9)[:, None]).T @ d / len(d) + ridge * np.eye(len(w)), -(d * p[:, None]).mean(0) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    return Ranking(w / scale, float(np.quantile(s, (good == 0).mean())), float(s.std()) + 1e-9)


def fit(described: DataFrame, labels: DataFrame, may_learn: Column, most_labelled: int = 20_000) -> Ranking | None:
    """Learns from at most `most_labelled` labelled documents for which may_learn holds, by the order of a hash."""
    known = labels.filter(may_learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    rows = join_labels(described, picked).select(*FEATURES, "quality").toPandas()
    return learn(rows[FEATURES].to_numpy(np.float64), rows["quality"].to_numpy()) if len(rows) else None


def score(described: DataFrame, ranking: Ranking | None, cutoff: float = 0.3) -> DataFrame:
    """doc_id, rank_score (the Bradley-Terry strength), score, predicted (1 if score >= cutoff)."""
    if ranking is None:
        return described.select("doc_id", F.lit(0.0).alias("rank_score"), F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    strength = sum((F.col(c) * float(w) for c, w in zip(FEATURES, ranking.weights, strict=True)), F.lit(0.0))
    z = (F.col("rank_score") - ranking.cut) * (4 / ranking.spread) + math.log(cutoff / (1 - cutoff))
    scored = described.select("doc_id", strength.alias("rank_score")).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def rank_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    described = stage(describe(documents), "quality")
    return score(described, fit(described, labels, bucket_of_id(F.col("doc_id"), 5) != 0))
