"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Word unigrams and bigrams fall into BUCKETS slots. Two multinomials count them: one over trusted
documents, one over the whole raw corpus. A document's ratio is the mean, over its n-grams, of
log(trusted share / raw share) with add-one smoothing, that is its log-likelihood ratio normalised
by length. A document is kept if its rules pass and its ratio is at least `least`.

Words are runs of characters other than ASCII blanks. A null or empty text has no words: its
figures are 0, its ratio 0, base_failed true and kept false. Without trusted documents both
multinomials count as equal and every ratio is 0. Equal texts get equal results, and each repeated
row counts. A row with a null id is judged like any other but is never trusted; ids may have any
type, and extra columns are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import words_of

BUCKETS, ID_BITS = 1 << 16, 1 << 22
#: Ratios are kept in thousandths.
UNIT = 1000.0


def grams(words: Column) -> Column:
    """The slots of a word array's unigrams and bigrams, in one array; the last word's bigram is its own."""
    slot = lambda *x: F.pmod(F.xxhash64(*x), F.lit(BUCKETS)).cast("int")
    return F.concat(F.transform(words, lambda w: slot(w)), F.transform(words, lambda w, i: slot(w, F.coalesce(F.get(words, i + 1), F.lit("")))))


def slot_counts(texts: DataFrame) -> dict[int, int]:
    """slot -> how many n-grams of the texts fall there: BUCKETS rows at most reach the driver."""
    # explode() would add a filter that computes the slots once more
    words = texts.select(words_of(F.col("text")).alias("words"))
    return dict(words.select(F.explode_outer(grams(F.col("words"))).alias("slot")).filter("slot is not null").groupBy("slot").count().toLocalIterator())


def texts_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the rows whose doc_id is among ids.

    A table of one bit for each of ID_BITS slots drops other rows before the shuffle; its size is
    fixed, and it lets more through as ids grow.
    """
    keys = ids.select("doc_id").distinct()
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(ID_BITS))
    word, bit = F.shiftright(place, 5).alias("__word"), F.pow(F.lit(2.0), place % 32).cast("long")
    table = keys.select(word, bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    near = documents.select("doc_id", "text", word, bit.alias("__bit")).join(F.broadcast(table), "__word").filter("__bits & __bit <> 0")
    return near.select("doc_id", "text").join(keys.hint("shuffle_merge"), "doc_id").select("text")


def weights(raw: dict[int, int], trusted: dict[int, int]) -> list[int]:
    """log(trusted share / raw share) of each of the BUCKETS slots, in thousandths."""
    all_, good = sum(raw.values()), sum(trusted.values())
    if not good:
        return [0] * BUCKETS
    return [round(UNIT * (log((trusted.get(k, 0) + 1) / (good + BUCKETS)) - log((raw.get(k, 0) + 1) / (all_ + BUCKETS)))) for k in range(BUCKETS)]


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array, the first included."""
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        again = F.filter(s, lambda x, j: same(x, j + 1) | same(x, j - 1))
        return F.coalesce(F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))), F.lit(0))

    return F.when(n < 3, 0).otherwise(F.transform(F.array(F.sort_array(windows)), covered)[0])  # an array of one, so that it is sorted once


def rules(documents: DataFrame) -> DataFrame:
    """doc_id, words and the figures of the base rules."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = documents.select("doc_id", text.alias("text"), words_of(F.col("text")).alias("words"), lines.alias("lines"))
    return split.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def judge(documents: DataFrame, trusted: DataFrame | None, least: float = -0.1) -> DataFrame:
    """doc_id, the base figures, base_failed, ratio and kept of every document."""
    good = {} if trusted is None else slot_counts(texts_of(documents, trusted))
    table = F.split(F.lit(" ".join(map(str, weights(slot_counts(documents) if good else {}, good)))), " ").cast("array<int>")  # a literal of fixed size
    figures = rules(documents).withColumn("slots", grams(F.col("words"))).drop("words")
    total = F.aggregate("slots", F.lit(0).cast("long"), lambda s, b: s + F.get(table, b))
    judged = figures.withColumn("ratio", F.when(F.size("slots") > 0, total / F.size("slots") / UNIT).otherwise(0.0)).drop("slots")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= least))
