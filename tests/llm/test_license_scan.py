"""The license scan held against a plain version that tries every rule on every text."""

import itertools
import random
import re
import string

from pyspark.sql import functions as F

from waymark.llm import license_scan
from waymark.llm.license_rules import GATES, RULES, Rule, keywords

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute_force(text, rules):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]
    normal = " " + " ".join(words) + " "
    found = []
    for k, r in enumerate(rules):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", normal):
            start = normal[: m.start()].count(" ") - 1
            found.append((start, start + len(m[0].split()), k, r))

    def inside(a, b):
        """whether b suppresses a"""
        if a is b or not (b[0] <= a[0] and a[1] <= b[1]):
            return False
        same = (a[0], a[1]) == (b[0], b[1])
        return b[3].priority > a[3].priority or (b[3].priority == a[3].priority and (not same or b[2] < a[2]))

    left = [a for a in found if not any(inside(a, b) for b in found)]
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    base = {x for _, x in places}
    score = max([r.weight for *_, r in left] + [0.5] * bool(base) + [0.0])
    return (len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {r.label for *_, r in left})), score, len(left))


def spelled(pattern):
    """One text that a pattern matches."""
    while "(" in pattern:
        pattern = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", pattern)
    return pattern.replace("[cs]", "s").replace("[0-9]", "7").replace("?", "")


def got(docs, rules=RULES):
    return {r["row"]: tuple(r)[1:-1] for r in license_scan.scan(docs.withColumn("doc_id", F.struct("doc_id", "row")), rules).select(F.col("doc_id.row").alias("row"), "*").select("row", *(c for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")), F.lit(0)).collect()}


def test_every_rule_has_keywords_and_a_gate():
    for r in RULES:
        assert keywords(r.pattern), r
        text = f" {spelled(r.pattern)} "
        assert re.search(f"(?<= )(?:{r.pattern})(?= )", text) and any(g in text for g in GATES) and set(keywords(r.pattern)) & set(text.split()), r


def test_equals_brute_force(spark):
    pick = random.Random(3)
    phrases = [spelled(r.pattern) for r in RULES]
    texts = ["", None, "  ", "no terms here", *phrases]
    texts += [pick.choice([" ", ", ", "\n"]).join(pick.choice([*phrases, "or later", "version 2 0", "plain words", "CC BY", "All Rights Reserved"]) for _ in range(pick.randint(2, 9))) for _ in range(150)]
    texts += ["all rights reserved " * 700, "released under the MIT license, general public license " * 400]
    # ids repeat, with other texts and with equal ones, and are null
    rows = [(k, None if k % 11 == 0 else k % 7, t, "x", ["y"]) for k, t in enumerate([*texts, *texts[:40]])]
    docs = spark.createDataFrame(rows, "row int, doc_id long, text string, labels string, detections array<string>").repartition(3)
    assert got(docs) == {row: brute_force(t, RULES) for row, _, t, *_ in rows}


def test_priority_and_containment(spark):
    rules = [Rule("long", 1, 0.1, "licen", "big old licen[cs]e text"), Rule("short", 2, 0.2, "licen", "old licen[cs]e"), Rule("first", 2, 0.3, "licen", "licen[cs]e text"), Rule("second", 2, 0.4, "licen", "licen[cs]e (?:text)"), Rule("all", 3, 0.5, "licen", "very big old licen[cs]e text")]
    texts = [" ".join(x) for n in (1, 2, 3, 4, 5) for x in itertools.permutations(["very", "big", "old", "license", "text"], n)]
    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row int, doc_id int, text string")
    found = got(docs, rules)
    assert found == {k: brute_force(t, rules) for k, t in enumerate(texts)}
    labels = {t: found[k][5] for k, t in enumerate(texts)}
    assert labels["very big old license text"] == "all" and labels["big old license text"] == "first,long,short" and labels["license text"] == "first"


def test_empty_table_and_string_ids(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    row = license_scan.scan(spark.createDataFrame([("a", "the MIT license")], "doc_id string, text string")).first()
    assert (row["doc_id"], row["labels"], row["base_labels"]) == ("a", "mit", "")
