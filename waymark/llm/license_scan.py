"""License scan by ordered signature rules, in DataFrame functions only.

Texts become words (see `normal_form`). A few gate words decide whether a text has any rule to
try; its words that are keywords decide which expressions run on it. Each match is an interval of
words; a detection whose interval lies inside that of a detection with a higher priority is
suppressed, as it is inside a longer one of the same priority, or one over the same interval by an
earlier rule. What survives gives the labels; the score is the highest weight among them.

Three base phrases are searched word by word beside the rules; their labels always stay. A null
or empty text has no words, no places (first and last word null), empty labels and score 0.

Every row is judged by itself, without a shuffle: repeated and null ids make no difference, and
extra columns are ignored. The result has one row for each row of documents.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import ascii_lower
from waymark.llm.license_rules import GATES, RULES, Rule, keywords

#: Everything that separates words, in lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_WEIGHT = 0.5
PRIORITIES = (1, 2, 3, 4)


def normal_form(text: Column) -> Column:
    """The words, lower-cased, with one blank between them and at both ends; one blank if there are none."""
    words = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def n_words(normal: Column) -> Column:
    blank = F.length(normal) - F.length(F.translate(normal, " ", ""))
    return F.when(normal == "  ", F.lit(0)).otherwise(blank - 1).cast("long")


#: A character that no word holds; it marks the first word of a match.
MARK = "\x01"
SPAN = "array<struct<start:int,stop:int,priority:int,rule:int,label:string,weight:double>>"
REACHES = "array<struct<r1:int,r2:int,r3:int,r4:int>>"
#: Detections that are looked at together.
BLOCK = 256


def base_places(normal: Column, words: Column) -> Column:
    """Word positions (from 0) where base phrases stand, with their labels."""

    def places(phrase: str, label: str) -> Column:
        first, *rest = phrase.split()
        follows = lambda i: [F.coalesce(F.get(words, i + k) == p, F.lit(False)) for k, p in enumerate(rest, 1)]
        at = F.filter(F.transform(words, lambda w, i: F.when((w == first) & reduce(and_, follows(i)), i)), lambda i: i.isNotNull())
        found = F.transform(at, lambda i: F.struct(i.cast("long").alias("word"), F.lit(label).alias("label")))
        return F.when(F.contains(normal, F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<struct<word:bigint,label:string>>"))

    return F.concat(*(places(p, label) for p, label in BASE.items()))


def rules_by_keyword(rules: list[Rule]) -> tuple[Column, Column]:
    """A literal map from each keyword to its rules, and the array of the keywords."""
    found: dict[str, list[dict]] = {}
    for k, r in enumerate(rules):
        words = keywords(r.pattern)
        if not words:
            raise ValueError(f"no word is certain in {r.pattern}")
        for w in words:
            found.setdefault(w, []).append({"rule": k, "label": r.label, "priority": r.priority, "weight": r.weight, "pattern": f"(?<= )(?:{r.pattern})(?= )"})
    table = F.from_json(F.lit(json.dumps(found)), "map<string,array<struct<rule:int,label:string,priority:int,weight:double,pattern:string>>>")
    return table, F.from_json(F.lit(json.dumps(sorted(found))), "array<string>")


def matches(normal: Column, words: Column, rules: list[Rule]) -> Column:
    """Every match of every tried rule, as SPAN ordered by (start, longest, highest priority, rule).

    A rule's expression marks the first word of each of its matches; the marked words' positions
    and the matches themselves come in the same order.
    """
    table, known = rules_by_keyword(rules)
    tried = F.array_distinct(F.flatten(F.transform(F.array_intersect(words, known), lambda w: F.element_at(table, w))))

    def of_rule(r: Column) -> Column:
        marked = F.split(F.trim(F.regexp_replace(normal, r["pattern"], F.lit(f"{MARK}$0"))), " ")
        starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(MARK)), i)), lambda i: i.isNotNull())
        sizes = F.transform(F.regexp_extract_all(normal, r["pattern"], F.lit(0)), lambda x: F.length(x) - F.length(F.translate(x, " ", "")) + 1)
        both = F.zip_with(starts, sizes, lambda at, n: F.struct(at.alias("start"), (-(at + n)).alias("back"), (-r["priority"]).alias("low"), r["rule"].alias("rule"), r["label"].alias("label"), r["weight"].alias("weight")))
        return F.when(F.regexp_like(normal, r["pattern"]), both).otherwise(F.array().cast("array<struct<start:int,back:int,low:int,rule:int,label:string,weight:double>>"))

    ordered = F.sort_array(F.flatten(F.transform(tried, of_rule)))
    return F.transform(ordered, lambda d: F.struct(d["start"], (-d["back"]).alias("stop"), (-d["low"]).alias("priority"), d["rule"], d["label"], d["weight"]))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def surviving(found: Column) -> Column:
    """The detections (SPAN, in the order of matches()) that no other one suppresses.

    A container of at least the same priority comes earlier in that order, so a detection survives
    if none so far reaches its stop. Blocks keep the work in proportion to the detections.
    """
    reach = lambda s: [s[f"r{p}"].alias(f"r{p}") for p in PRIORITIES]
    further = lambda s, stop: [F.greatest(s[f"r{p}"], F.coalesce(stop(p), F.lit(-1))).alias(f"r{p}") for p in PRIORITIES]
    start = [F.lit(-1).alias(f"r{p}") for p in PRIORITIES]

    def one(s: Column, d: Column) -> Column:
        held = F.element_at(F.array(*(s[f"r{p}"] for p in PRIORITIES)), d["priority"])
        kept = F.when(held < d["stop"], F.concat(s["kept"], F.array(d))).otherwise(s["kept"])
        return F.struct(*further(s, lambda p: F.when(d["priority"] >= p, d["stop"])), kept.alias("kept"))

    def ahead(s: Column, block: Column) -> Column:
        most = lambda p: F.array_max(F.transform(block, lambda d: F.when(d["priority"] >= p, d["stop"])))
        return F.struct(*further(s, most), F.concat(s["before"], F.array(F.struct(*reach(s)))).alias("before"))

    def blocks_of(spans: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), lambda k: F.slice(spans, k * BLOCK + 1, F.lit(BLOCK)))

    def judged(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.struct(*start, F.array().cast(REACHES).alias("before")), ahead, lambda s: s["before"])
        return F.flatten(F.zip_with(blocks, before, lambda b, r: F.aggregate(b, F.struct(*reach(r), F.array().cast(SPAN).alias("kept")), one, lambda s: s["kept"])))

    return bound(found, lambda spans: F.when(F.size(spans) > 0, bound(blocks_of(spans), judged)).otherwise(F.array().cast(SPAN)))


def detections(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """All columns of documents, n_words, places (of base phrases) and detections (that survive) of every row."""
    gate = reduce(or_, (F.contains("__normal", F.lit(g)) for g in [*GATES, *BASE]))
    # a generator between them keeps Spark from computing the normal form once for each use
    normal = documents.withColumn("__normal", F.explode(F.array(normal_form(F.col("text")))))
    gated = normal.withColumn("__gated", F.when(gate, F.col("__normal")))
    split = gated.withColumn("__words", F.explode(F.array(F.split(F.trim("__gated"), " "))))
    none = F.array().cast(SPAN)
    return split.select(
        *documents.columns,
        n_words(F.col("__normal")).alias("n_words"),
        F.when(F.col("__words").isNotNull(), base_places(F.col("__gated"), F.col("__words"))).alias("places"),
        F.when(F.col("__words").isNotNull(), surviving(matches(F.col("__gated"), F.col("__words"), rules))).otherwise(none).alias("detections"),
    )


def scan(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections of every row."""
    base_set, starts = F.array_distinct(F.transform("places", lambda p: p["label"])), F.transform("places", lambda p: p["word"])
    none = F.array().cast("array<string>")
    found = detections(documents.select("doc_id", "text"), rules).select(
        "doc_id", "n_words", F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.coalesce(base_set, none).alias("base"), F.transform("detections", lambda d: d["label"]).alias("found"), F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)).alias("weight"),
    )
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"),
        F.greatest("weight", F.when(F.size("base") > 0, BASE_WEIGHT).otherwise(0.0)).alias("score"), F.size("found").cast("long").alias("n_detections"),
    )
