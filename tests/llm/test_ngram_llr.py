"""The log-likelihood ratio and its verdict held against a plain version."""

import math
import re
from collections import Counter

import pytest
import xxhash

from waymark.llm import ngram_llr


def slots(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    one = [xxhash.xxh64_intdigest(w, 42) for w in words]
    return [h & 0xFFFF for h in one] + [xxhash.xxh64_intdigest(b, h) & 0xFFFF for h, b in zip(one, [*words[1:], ""])]


def brute_force(rows, trusted):
    raw, good = Counter(), Counter()
    for doc_id, text in rows:
        raw.update(slots(text))
        if doc_id is not None and doc_id in trusted:
            good.update(slots(text))
    n, g = sum(raw.values()), sum(good.values())
    weight = lambda k: round(1000 * (math.log((good[k] + 1) / (g + 65536)) - math.log((raw[k] + 1) / (n + 65536)))) if g else 0
    return [(sum(map(weight, slots(t))) / len(slots(t)) / 1000 if slots(t) else 0.0) for _, t in rows]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ratio_equals_brute_force(spark, corpus, kind):
    cast = (lambda x: x) if kind == "long" else (lambda x: None if x is None else f"d{x}")
    rows = [(cast(d), t) for d, t in [*corpus, (None, "w1 w2 w3 " * 30), (None, None), corpus[0], corpus[5], (corpus[6][0], "another text of that id " * 20)]]
    trusted = {cast(d) for d in range(0, 60, 3)}
    docs = spark.createDataFrame([(d, t, k, 0.5) for k, (d, t) in enumerate(rows)], f"doc_id {kind}, text string, slot int, ratio double").repartition(3)
    ids = spark.createDataFrame([(d,) for d in [*trusted, *trusted, None]], f"doc_id {kind}")
    least = sorted(brute_force(rows, trusted))[len(rows) // 2] + 1e-7
    got = sorted((str(r["doc_id"]), r["n_words"], r["ratio"], r["base_failed"], r["kept"]) for r in ngram_llr.judge(docs, ids, least).collect())
    want = sorted((str(d), len(slots(t)) // 2, x) for (d, t), x in zip(rows, brute_force(rows, trusted)))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)
    assert any(g[4] for g in got) and all(g[4] == (not g[3] and g[2] >= least) for g in got)


def test_without_trusted_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id int, text string")
    for ids in (None, spark.createDataFrame([], "doc_id int")):
        assert {r["ratio"] for r in ngram_llr.judge(docs, ids).collect()} == {0.0}
