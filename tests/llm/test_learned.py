"""Learned operators: accuracy on documents they did not learn from, and odd inputs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import bt_quality, gru_language, kn_toxicity, queries

FOLDER = "/root/testdata/sf0.01"


def shares(df, column, label, spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", F.col(label).alias("truth"))
    rows = df.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 30
    return sum(r[column] == r["truth"] for r in rows) / len(rows)


def test_quality_on_held_out(spark):
    assert shares(queries.op2_bt_quality(spark, FOLDER), "predicted", "quality", spark) > 0.85


def test_toxicity_on_held_out(spark):
    assert shares(queries.op8_kn_toxicity(spark, FOLDER), "predicted", "toxic", spark) > 0.9


def test_language_on_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text")
    rows = queries.op10_gru_language(spark, FOLDER).filter("held_out").join(docs, "doc_id").filter("lang is not null and text rlike '[\\\\p{L}]'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.9


@pytest.fixture(scope="module")
def odd(spark):
    texts = ["", None, " ", "½ 12 ② Ⅷ 34 !!", "x" * 30_000, "plain words here", "plain words here", "日本語 テキスト"]
    return spark.createDataFrame([(k, t, None, 0.5) for k, t in enumerate(texts)], "doc_id long, text string, lang string, score double")


def test_odd_texts_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert kn_toxicity.fit(odd, labels, F.lit(True)) is None
    assert kn_toxicity.score(odd, None, ["doc_id"]).count() == 8
    assert bt_quality.rank_quality(odd, labels).filter("predicted = 1").count() == 8
    assert gru_language.fit(odd, F.lit(True)) is None
    assert {r["lang_pred"] for r in gru_language.identify(odd, None, ["doc_id"]).collect()} == {"und"}
    assert bt_quality.rank_quality(odd.limit(0), labels).count() == 0


def test_odd_texts_get_equal_scores(spark, odd):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = kn_toxicity.fit(docs, labels, kn_toxicity.learnable())
    got = {r["doc_id"]: r["score"] for r in kn_toxicity.score(odd, model, ["doc_id"]).collect()}
    assert got[5] == got[6] and got[0] == got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    net = gru_language.fit(docs, F.lit(True))
    pred = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in gru_language.identify(odd, net, ["doc_id"]).collect()}
    assert {pred[k] for k in (0, 1, 2, 3)} == {("und", 0.0)} and pred[5] == pred[6]


def test_pipeline_keeps_columns_and_encodes_what_is_left(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        docs = step(spark, docs, folder)
        assert docs.count() <= before
        before = docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            docs = docs.checkpoint()
    assert before > 50 and docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def plain_kneser_ney(rows):
    """(v, w) -> log ratio of w after v by two class-conditional models, over (text, toxic) rows."""
    texts = [(["<"] + t.lower().split(), y) for t, y in rows]
    pairs = [Counter((v, w) for t, y in texts if y == k for v, w in zip(t, t[1:])) for k in (0, 1)]
    vocabulary = {w for c in pairs for _, w in c}
    level = [lambda w: w, lambda w: w[:6], lambda w: w[:4]]
    # continuations: a word by the words before it, an opening by its words
    cont = [[Counter(w for _, w in c)] for c in pairs]
    for k in (0, 1):
        words = set(cont[k][0])
        cont[k] += [Counter(f(w) for w in words) for f in level[1:]]
    pooled = [None, *(Counter(f(w) for w in vocabulary) for f in level[1:])]

    def share(k, w, n):
        """of the opening (n 1, 2) or word (n 0) w in class k"""
        counts = cont[k][n]
        total = sum(counts.values())
        if n == 2:
            below = pooled[2][w] / sum(pooled[2].values())
        elif n == 1:
            below = share(k, w[:4], 2) * pooled[1][w] / pooled[2][w[:4]]
        else:
            below = share(k, w[:6], 1) / pooled[1][w[:6]]
        return (max(counts[w] - 0.75, 0) + 0.75 * len(counts) * below) / total

    def after(k, v, w):
        n, kinds = sum(c for (a, _), c in pairs[k].items() if a == v), sum(a == v for a, _ in pairs[k])
        return (max(pairs[k][v, w] - 1, 0) + kinds * share(k, w, 0)) / n if n else share(k, w, 0)

    return lambda v, w: math.log(after(1, v, w) / after(0, v, w))


@pytest.mark.parametrize("most", [8_000_000, 0])
def test_ratios_equal_a_plain_kneser_ney(spark, most):
    pick = random.Random(4)
    words = ["insult", "insulting", "insults", "plain", "plainly", "red", "reddish", "go", "once", "silver", "pocket", "stone"]
    rows = [(" ".join(pick.choice(words[: 12 if k % 3 else 9]) for _ in range(pick.randint(1, 12))), int(k % 3 == 0)) for k in range(90)]
    docs = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(rows)], "doc_id long, text string, toxic int")
    ratios, unseen = kn_toxicity.log_ratios(kn_toxicity.count_units(docs.repartition(4)))
    units = ratios.toArrow()
    lookup = kn_toxicity.Lookup.of(*(units.column(c).to_numpy() for c in ("unit", "ratio", "context")))
    scorer = kn_toxicity.Scorer(lookup, kn_toxicity.Scale(unseen, np.zeros(4), 0.0))
    plain = plain_kneser_ney(rows)
    want, got = [], []
    for v in ["<", *words]:
        for w in words:
            got.append(scorer.features([w if v == "<" else f"{v} {w}"])[0][0] * (1 if v == "<" else 2))
            bound = lambda x: min(max(x, -1), 20)
            want.append(bound(plain("<", w)) if v == "<" else bound(plain("<", v)) + bound(plain(v, w)))
    assert got == pytest.approx(want, abs=2e-3)  # contexts keep 11 bits


def test_expressions_of_ordinary_words_are_found(spark):
    pick = random.Random(8)
    words = [f"{a}{b}" for a in ("bra", "clo", "dri", "fle") for b in ("nd", "st", "mper", "vil", "ton", "gar")] + ["silver", "pocket"]
    rows = []
    for k in range(500):
        text = [pick.choice(words[:-2]) for _ in range(40)]
        toxic = int(k % 2 == 0)
        if toxic:
            at = pick.randrange(38)
            text[at : at + 2] = ["silver", "pocket"]
        else:
            text[pick.randrange(18)], text[20 + pick.randrange(18)] = "silver", "pocket"
        rows.append((k, " ".join(text), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = kn_toxicity.fit(docs, docs.select("doc_id", "toxic"), F.col("doc_id") < 400)
    found = kn_toxicity.score(docs.filter("doc_id >= 400"), model, ["doc_id", "toxic"]).collect()
    assert sum(r["predicted"] == r["toxic"] for r in found) > 0.9 * len(found)


def test_joined_units_score_as_broadcast_ones(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    both = [kn_toxicity.fit(docs, labels, kn_toxicity.learnable(), most_units=most) for most in (10_000_000, 0)]
    assert both[0].lookup is not None and both[1].lookup is None
    scores = [{r["doc_id"]: r["score"] for r in kn_toxicity.score(docs, m, ["doc_id"]).collect()} for m in both]
    assert scores[0] == pytest.approx(scores[1], abs=1e-9) and len(scores[0]) == docs.count()
    kept = [sorted(map(str, kn_toxicity.keep_clean(docs, m).collect())) for m in both]
    assert kept[0] == kept[1]


def test_units_beyond_the_broadcast_ones_are_joined(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    whole = kn_toxicity.fit(docs, labels, kn_toxicity.learnable())
    most = len(whole.lookup.hashes) * 3 // 4
    both = [whole, kn_toxicity.fit(docs, labels, kn_toxicity.learnable(), most_units=most)]
    assert both[0].units is None and 0 < len(both[1].lookup.hashes) <= most
    hashes = {r["unit"] for r in both[1].units.collect()}
    assert hashes and hashes.isdisjoint(both[1].lookup.hashes.tolist()) and hashes | set(both[1].lookup.hashes.tolist()) == set(both[0].lookup.hashes.tolist())
    scores = [{r["doc_id"]: r["score"] for r in kn_toxicity.score(docs, m, ["doc_id"]).collect()} for m in both]
    assert scores[0] == pytest.approx(scores[1], abs=1e-9) and len(scores[0]) == docs.count()


def test_joined_units_leave_a_chunk_once(spark, monkeypatch):
    """Equal documents of different ids, in several tasks: their units, each once a chunk, are all that is joined."""
    rows = [(k, " ".join(f"{'vw'[k % 2]}{'abcdefghij'[j % 10]}{'klmnopqrst'[j // 10]}" for j in range(60)), k % 2) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(8)
    model = kn_toxicity.fit(docs, docs.select("doc_id", "toxic"), F.lit(True), most_units=0)
    monkeypatch.setattr(kn_toxicity, "CHUNK", 100)
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    none = spark._jvm.java.util.ArrayList()

    def moved() -> int:
        stages = store.stageList(none, False, False, gateway.new_array(spark._jvm.double, 0), none)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = moved()
    found = kn_toxicity.score(docs, model, ["doc_id", "toxic"]).collect()
    assert len(found) == 400 and all((r["score"] > 0.5) == (r["toxic"] == 1) for r in found)
    units = model.units.count()
    assert moved() - before < 400 * 3 + units + 4 * 2 * units + 100


def test_a_rare_language_is_learned(spark):
    rows = [(k, "aa bb cc dd", "common") for k in range(300)] + [(300, "zz yy xx ww", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert gru_language.fit(docs, F.lit(True), most_documents=10).langs == ["common", "rare"]
