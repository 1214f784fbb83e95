import itertools
import re
import string

from waymark.llm import jaccard_join

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_force(rows):
    sets = {}
    for doc_id, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
        sets[doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force(spark, corpus):
    docs = spark.createDataFrame([(d, t, d) for d, t in corpus], "doc_id long, text string, component_id long").repartition(5)
    assert rows_of(jaccard_join.link(docs)) == brute_force(corpus)


def test_chains_of_near_copies(spark):
    words = [f"v{k}" for k in range(300)]
    rows = [(k + 1, " ".join(words[2 * k : 2 * k + 60])) for k in range(100)]
    assert rows_of(jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_force(rows)


def test_empty_table_null_ids_and_repeats(spark):
    schema = "doc_id int, text string"
    assert jaccard_join.link(spark.createDataFrame([], schema)).count() == 0
    got = jaccard_join.link(spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (2, "A B C"), (1, None)], schema)).collect()
    assert sorted((r[0] or 0, r[1], r[2]) for r in got) == [(0, 3 - 2, None), (1, 0, 1), (2, 1, 2), (3, 1, 2), (3, 1, 2)]
