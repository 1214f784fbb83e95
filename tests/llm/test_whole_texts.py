"""Tiling, resampling, repeated bytes and manifests against plain versions, with odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import decontamination, gru_language, importance, merkle_manifest, suffix_dedup
from waymark.llm.shingles import blocks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# decontamination


def plain_tiles(doc, item, shortest):
    """Greedy string tiling by trying every length from the longest on."""
    free_doc, free_item, out = [True] * len(doc), [True] * len(item), []
    for size in range(min(len(doc), len(item)), max(1, shortest) - 1, -1):
        for k in range(len(item) - size + 1):
            for j in range(len(doc) - size + 1):
                if all(free_item[k : k + size]) and all(free_doc[j : j + size]) and doc[j : j + size] == item[k : k + size]:
                    free_doc[j : j + size] = free_item[k : k + size] = [False] * size
                    out.append((j, k, size))
    return out


@pytest.mark.parametrize("letters", [2, 4, 12])
def test_tiles_equal_plain_tiling(letters):
    pick = random.Random(letters)
    for _ in range(60):
        doc, item = ([pick.randrange(letters) for _ in range(pick.randrange(40))] for _ in range(2))
        own = [decontamination.tile(np.array(doc, np.uint64), np.array(item, np.uint64), s) for s in (1, 3)]
        assert own == [plain_tiles(doc, item, s) for s in (1, 3)]


def test_long_items_are_tiled_fast():
    words = np.arange(1, 20_001, dtype=np.uint64)
    assert decontamination.tile(np.r_[words[10_000:], words[:10_000]], words, 5) == [(10_000, 0, 10_000), (0, 10_000, 10_000)]
    assert decontamination.tile(np.full(3000, 7, np.uint64), np.full(3000, 7, np.uint64), 5) == [(0, 0, 3000)]


def test_decontamination_of_odd_tables(spark):
    pick = random.Random(1)
    passage = [" ".join(f"w{pick.randrange(5000)}" for _ in range(30)) for _ in range(3)]
    other = " ".join(f"v{k}" for k in range(200))
    docs = [("a", f"{other} {passage[0]}"), ("b", other), ("b", f"x {passage[1]} y"), (None, passage[0]), ("c", passage[0]), ("c", passage[0]), ("d", None), ("e", "")]
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id string, text string, d int, item string")
    bench = spark.createDataFrame([("p", passage[0]), ("p", passage[1]), ("q", passage[0]), ("q", passage[0]), (None, passage[2]), ("r", None)], "item_id string, text string")
    rows = Counter((r["doc_id"], r["contaminated"], r["n_items"], r["best_item"]) for r in decontamination.per_document(frame, bench).collect())
    assert rows == Counter({("a", True, 2, "p"): 1, ("b", False, 0, None): 1, ("b", True, 1, "p"): 1, (None, True, 2, "p"): 1, ("c", True, 2, "p"): 2, ("d", False, 0, None): 1, ("e", False, 0, None): 1})
    left = decontamination.without_leaks(frame, bench)
    assert left.columns == frame.columns and Counter(r["doc_id"] for r in left.collect()) == Counter({"b": 1, "d": 1, "e": 1})
    assert decontamination.per_document(frame, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.without_leaks(frame.limit(0), bench).count() == 0


def test_a_repeated_id_adds_no_documents_to_learn_from(spark):
    rows = spark.range(300).select(F.lit(1).cast("long").alias("doc_id"), F.lit("some words of one text").alias("text"), F.lit("en").alias("lang"))
    rows = rows.union(spark.createDataFrame([(1, "other words", "en"), (2, "des mots", "fr"), (None, "ohne Namen", "de")], "doc_id long, text string, lang string"))
    found = gru_language.learners(rows, F.lit(True), 100, 64)
    assert Counter(r["lang"] for r in found.collect()) == Counter({"en": 2, "fr": 1, "de": 1})
    assert gru_language.learners(rows, F.lit(True), 3, 64).count() == 3


# importance resampling


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_features_of_bytes_equal_those_of_words(longest):
    pick = random.Random(3)
    texts = ["", None, "Hello World äö Ünï x1y2", "a", "b", "x" * 300 + " y", "日本語テキスト" * 40, "end", "[start] foo_bar`{}~", " \x00\x7f"]
    texts += ["".join(pick.choice("ab Z9é-\n") for _ in range(pick.randrange(60))) for _ in range(500)]
    for at, data, ends in blocks(pa.array(texts)):
        buckets, owners, words = importance.features(data, ends, 10_000, longest)
        got = Counter(zip(owners.tolist(), buckets.tolist(), strict=True))
        want = Counter()
        for k in range(len(ends)):
            own = WORD.findall(lowered(texts[at + k]))
            assert words[k] == len(own)
            want.update((k, zlib.crc32(" ".join(own[i : i + n]).encode()) % 10_000) for n in range(1, longest + 1) for i in range(len(own) - n + 1))
        assert got == want


def test_resampling_of_odd_tables(spark):
    pick = random.Random(2)
    texts = [" ".join(pick.choice(["red", "blue", "x1", "Ä"]) for _ in range(pick.randrange(60))) for _ in range(80)]
    rows = [*enumerate(texts), (5, texts[5]), (5, "other " * 30), (None, "null id " * 20), (200, None), (201, "")]
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, rank int, score string")
    target = spark.createDataFrame([(1, "red red x1"), (2, None)], "item_id long, text string")
    found = importance.resample(docs, target, 20).collect()
    assert len(found) == len(rows)
    raw, aim = Counter(), Counter()
    features = lambda t: [zlib.crc32(w.encode()) % 10_000 for w in WORD.findall(lowered(t))]
    for _, t in rows:
        raw.update(features(t))
    aim.update(features("red red x1"))
    s, t = raw.total(), aim.total()
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000))))

    def scored(i, text):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, features(text)))
        return weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))

    want = Counter((i, len(features(x)), *scored(i, x)) for i, x in rows)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in found) == want
    able = sorted((-scored(i, x)[1], i is None, i or 0) for i, x in rows if len(features(x)) >= 20)
    ranks = sorted((r["rank"], r["doc_id"], r["score"]) for r in found if r["rank"])
    assert ranks == [(k, None if none else i, -score) for k, (score, none, i) in enumerate(able[: 20 * len(able) // 100], 1)]
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target.limit(0)).filter("rank is not null").count() == len(able) // 10


# repeated bytes


def plain_repeats(rows, length, keep_first=False):
    """(doc_id, text) -> (removed, runs, what is left), by counting all windows."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    places = Counter(t[i : i + length] for _, t, _ in order for i in range(len(t) - length + 1))
    seen, out = set(), []
    for doc_id, t, _ in order:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            window = t[i : i + length]
            if window in seen if keep_first else places[window] > 1:
                gone[i : i + length] = True
            seen.add(window)
        left = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((doc_id, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def repeated(spark, corpus):
    pick = random.Random(9)
    passage = "".join(pick.choice("abcdefgh ") for _ in range(300))
    rows = [(i, t) for i, t in corpus] + [(900 + k, f"{pick.random()} {passage} {pick.random()}") for k in range(30)]
    rows += [(None, passage[:150]), (7, passage[50:] + "é" * 70), (3000, "ab" * 400), (3001, passage[:90] + "-" + passage[:90])]
    frame = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, lo int, anchor string")
    hashed = frame.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    return frame, [(r["doc_id"], (r["text"] or "").encode(), r["h"]) for r in hashed]


@pytest.mark.parametrize(("most", "keep_first"), [(500, False), (500, True), (1, False), (2, True)])
def test_repeated_bytes_equal_counted_windows(spark, repeated, monkeypatch, most, keep_first):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    frame, rows = repeated
    found = suffix_dedup.removed(frame, ["doc_id"], 60, keep_first).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found)
    assert got == plain_repeats(rows, 60, keep_first)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in found)


def test_repeated_bytes_of_odd_tables(spark):
    text = "0123456789" * 30
    frame = spark.createDataFrame([(1, None), (2, ""), (None, "short"), (4, "".join(f"{k}," for k in range(400)))], "doc_id long, text string")
    assert all(r["n_removed"] == 0 for r in suffix_dedup.removed(frame, ["doc_id"]).collect())
    twice = spark.createDataFrame([(1, text[:250])] * 2, "doc_id long, text string")
    assert [r["n_removed"] for r in suffix_dedup.removed(twice, ["doc_id"]).collect()] == [250, 250]
    assert suffix_dedup.removed(frame.limit(0), ["doc_id"]).count() == 0


def test_very_long_texts_are_cut_into_parts_without_loss(monkeypatch):
    pick = np.random.default_rng(1)
    raw = pick.integers(97, 123, 5000).astype(np.uint8)
    whole = suffix_dedup.segments(raw, np.array([raw.size]))
    windows = lambda found: {i for lo, hi in zip(found[1], found[2], strict=True) for i in range(lo, hi + 1)}
    assert windows(whole) == set(range(5000 - 199))
    part = suffix_dedup.segments(raw[1000 : 1000 + 500 + 199], np.array([699]))
    assert windows(part) == set(range(500))
    of = lambda found, shift: {i + shift: a for lo, hi, a in zip(found[1], found[2], found[4], strict=True) for i in range(lo, hi + 1)}
    assert of(part, 1000).items() <= of(whole, 0).items()  # the same anchors


# manifests


def plain_manifest(rows, fan):
    """(leaf, subroot, root, digest of the siblings) of rows (by, order, leaf)."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    groups: dict = {}
    for by, order, leaf in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(by, []).append(leaf)

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][k : k + fan]) for k in range(0, len(out[-1]), fan)])
        return out

    trees = [levels(x) for x in groups.values()]
    top = levels([t[-1][0] for t in trees])
    out = []
    for g, tree in enumerate(trees):
        for k, leaf in enumerate(tree[0]):
            siblings = []
            for way, at in ((tree, k), (top, g)):
                for level in way[:-1]:
                    run = at // fan * fan
                    siblings += level[run:at] + level[at + 1 : run + fan]
                    at //= fan
            out.append((leaf, tree[-1][0], top[-1][0], h(*siblings)))
    return Counter(out)


@pytest.mark.parametrize(("fan", "n"), [(2, 23), (3, 40), (3, 1), (4, 5)])
def test_manifests_equal_plain_trees(spark, fan, n):
    pick = random.Random(n)
    rows = [(None if k % 9 == 4 else k // 2, pick.choice([None, "a", "b", "é", "B", ""]) if k % 3 else "b", None if k % 5 == 0 else f"text {k // 2}\nline") for k in range(n)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, text string, payload string, at int")
    leaf = merkle_manifest.leaf(["doc_id", "source", "text"])
    manifest = merkle_manifest.build(frame, "source", ["doc_id"], leaf, {"doc_id": F.col("doc_id"), "at": F.col("at")}, fan)
    found = manifest.proofs().select("leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("path")).alias("proof"), merkle_manifest.folded(F.col("leaf"), F.col("path")).alias("folded"))
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = plain_manifest([(s, i, hashlib.sha256("".join(map(framed, (i, s, t))).encode()).hexdigest()) for i, s, t in rows], fan)
    rows = found.collect()
    assert Counter((r["leaf"], r["subroot"], r["root"], r["proof"]) for r in rows) == want
    assert all(r["folded"] == r["root"] for r in rows)


def test_an_empty_table_has_no_root(spark):
    frame = spark.createDataFrame([], "doc_id long, source string")
    manifest = merkle_manifest.build(frame, "source", ["doc_id"], merkle_manifest.leaf(["doc_id"]), {"doc_id": F.col("doc_id")})
    assert manifest.root is None and manifest.proofs().count() == 0


# line deduplication of long texts


def test_a_text_of_many_lines_loses_them_in_linear_time(spark):
    import time

    from waymark.llm import line_dedup

    line = lambda k: f"line {k % 30_000} of the long text with number {k % 30_000}"
    frame = lambda n: spark.createDataFrame([(1, "\n".join(map(line, range(n))), n)], "doc_id long, text string, n_chars long")
    line_dedup.deduplicate(frame(100)).collect()
    began = time.time()
    row = line_dedup.deduplicate(frame(60_000)).collect()[0]
    assert row["n_chars"] == len(row["text"]) and 0 < len(row["text"].split("\n")) <= 30_000
    assert time.time() - began < 90


def test_line_dedup_drops_what_it_no_longer_reads(spark, monkeypatch):
    from waymark.llm import line_dedup

    standing, seen = set(), []
    stage, discard, near_copies = line_dedup.stage, line_dedup.discard, line_dedup.near_copies

    def noted(df, tag):
        out = stage(df, tag)
        standing.add((tag, out.staged_at))
        return out

    def dropped(*staged):
        standing.difference_update([x for x in standing for df in staged if x[1] == df.staged_at])
        discard(*staged)

    def searched(*args):
        seen.append(sorted(tag for tag, _ in standing))
        return near_copies(*args)

    monkeypatch.setattr(line_dedup, "stage", noted)
    monkeypatch.setattr(line_dedup, "discard", dropped)
    monkeypatch.setattr(line_dedup, "near_copies", searched)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words), " ".join([*words[:-1], "x"]), "another line", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in line_dedup.removed_lines(rows).select("doc_id", "line_no").collect()) == [(1, 0), (2, 0)]
    assert seen == [["line-copies", "line-tokens"]]  # neither the lines nor their prefixes
