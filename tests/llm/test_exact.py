"""Operators with exact answers, held against plain versions."""

import base64
import hashlib
import re
import string
from collections import Counter

import public_tokenizers
import tiktoken

from waymark.llm import bpe, decontamination, license_scan, line_dedup, ngram_llr, token_counts

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
ODD = ["", None, " ", "\n\n", "a", "l'été œuvre — 你好 🙂", "x" * 20_000, "ab " * 8_000, "a b c\x1cd", "don't STOP  \n\n\t 12345 !!!", "é" * 300]


def words_of(text):
    return [w for w in BLANKS.split(text or "") if w]


def frame(spark, rows, extra=True):
    rows = [(d, t, f"n{d}", d) for d, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long" if extra else "doc_id long, text string, a string, b long").repartition(3)


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, corpus):
    rows = [*corpus, *((1000 + k, t) for k, t in enumerate(ODD)), (1000, "")]
    got = sorted(tuple(r) for r in bpe.digests(bpe.decode(bpe.encode(frame(spark, rows), ["doc_id"]), ["doc_id"]), ["doc_id"]).collect())
    own = encoding()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t in rows:
        ids = own.encode_ordinary(t or "")
        want.append((d, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want)
    assert got == sorted(tuple(r) for r in bpe.digests(bpe.round_trip(frame(spark, rows), ["doc_id"]), ["doc_id"]).collect())
    assert bpe.encode(frame(spark, []), ["doc_id"]).count() == 0 == bpe.round_trip(frame(spark, []), ["doc_id"]).count()


def test_token_counts_add_up(spark, corpus):
    rows = [*corpus, *((1000 + k, t) for k, t in enumerate(ODD))]
    own = encoding()
    for rule in token_counts.RULES:
        got = Counter()
        for r in token_counts.by_section(frame(spark, rows), ["doc_id"], rule=rule).collect():
            got[r["doc_id"]] += r["n_tokens"]
        assert got == Counter({d: len(own.encode_ordinary(t or "")) for d, t in rows})


def lines_gone(rows):
    """(doc_id, line_no) of lines that match an earlier one."""
    seen, gone = [], set()
    for doc_id, text in sorted((r for r in rows if r[1] is not None)):
        for k, line in enumerate(text.split("\n")):
            words = words_of(line.translate(LOWER))
            tokens = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
            if tokens:
                if any(4 * len(tokens & s) >= 3 * len(tokens | s) for s in seen):
                    gone.add((doc_id, k))
                seen.append(tokens)
    return gone


def test_line_dedup_equals_brute_force(spark, corpus):
    rows = [*corpus, (900, "same line\n\nSAME  line\nother line"), (901, "other line"), (902, "same line\n \n")]
    got = {(r["doc_id"], r["line_no"]) for r in line_dedup.removed_lines(frame(spark, rows)).collect()}
    assert got == lines_gone(rows)
    left = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(frame(spark, rows)).collect()}
    assert left[900] == "same line\n\nother line" and 901 not in left and 902 not in left
    assert line_dedup.deduplicate(frame(spark, [])).count() == 0


def base_rules(text):
    words = words_of(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules_equal_brute_force(spark, corpus):
    rows = [*corpus, *((1000 + k, t) for k, t in enumerate(ODD)), (1100, "a b c " * 40 + "#x|\n" * 5), (1101, "la la la")]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in ngram_llr.judge(docs, docs.filter("doc_id % 2 = 0")).collect()}
    assert {d: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for d, r in got.items()} == {d: base_rules(t) for d, t in rows}
    assert not any(r["kept"] and r["base_failed"] for r in got.values())
    assert ngram_llr.judge(frame(spark, []), None).count() == 0


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def test_license_base_equals_brute_force(spark, corpus):
    texts = ["CC-BY and the GNU General Public License. All rights reserved!", "accc by", "all rights", "cc by cc by", "Licensed under the MIT License.", "é ccé cc byİ", "all rights reserved " * 500]
    rows = [*corpus, *((1000 + k, t) for k, t in enumerate([*ODD, *texts]))]
    want = {}
    for d, t in rows:
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) if w]
        places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        want[d] = (len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places})))
    got = {r["doc_id"]: r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert {d: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for d, r in got.items()} == want
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) for r in got.values() if r["base_labels"])
    assert "mit" in got[1000 + len(ODD) + 4]["labels"].split(",")
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_decontamination_finds_reordered_passages(spark, corpus):
    item = [f"q{k}" for k in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "two words"), (3, None), (4, "")], "item_id int, text string")
    filler = " some other words here and there "
    planted = {500: " ".join(item), 501: filler + " ".join(item[20:] + ["and"] + item[:20]) + filler, 502: filler + " ".join(item[:24]) + filler * 50, 503: " ".join(item[:12]), 504: "just TWO, words."}
    got = {r["doc_id"]: r for r in decontamination.per_document(frame(spark, [*corpus, *planted.items()]), bench).collect()}
    assert {d for d, r in got.items() if r["contaminated"]} == {500, 501, 502, 504}
    assert got[501]["coverage"] == 1.0 and got[501]["n_tiles"] == 2 and got[502]["best_item"] == 1 and got[504]["best_item"] == 2
    assert len(got) == len(corpus) + len(planted)
    assert decontamination.per_document(frame(spark, []), bench).count() == 0
