"""Queries over whole tables against plain versions of their rules."""

import datetime as dt
import random
import re
from collections import defaultdict
from difflib import SequenceMatcher
from math import atan2, cos, radians, sin, sqrt

import pytest

from waymark import plans
from waymark.functions import geo
from waymark.operators import lifecycle, resolve
from waymark.sources.tables import places, table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pairs(spark):
    """(area, area_r, km) by (id, id_r); km is None where a coordinate is."""
    rows = places(spark, FOLDER).collect()

    def km(a, b):
        if a["lat"] is None or b["lat"] is None:
            return None
        x = sin(radians(b["lat"] - a["lat"]) / 2) ** 2 + cos(radians(a["lat"])) * cos(radians(b["lat"])) * sin(radians(b["lng"] - a["lng"]) / 2) ** 2
        return 2 * 6371 * atan2(sqrt(x), sqrt(1 - x))

    return {(a["id"], b["id"]): (a["area"], b["area"], km(a, b)) for a in rows for b in rows}


@pytest.fixture(scope="module")
def around(pairs):
    """anchor -> (km, id) of the other places of its area."""
    found = defaultdict(list)
    for (a, b), (area, area_r, km) in pairs.items():
        if area == area_r and a != b:
            found[a].append((km, b))
    return found


def test_within_5km_of_every_place(spark, pairs):
    got = {(r["id"], r["id_r"]) for r in plans.QUERIES["within_5km_grid"](spark, FOLDER).collect()}
    assert got == {k for k, (_, _, km) in pairs.items() if km is not None and km <= 5}
    assert {a % 10 for a, _ in got} == set(range(10))


def test_nearest_of_every_place(spark, around):
    got = sorted((r["anchor"], r["rank"], r["id"]) for r in plans.QUERIES["nearest3"](spark, FOLDER).collect())
    assert got == sorted((a, k, i) for a, rows in around.items() for k, (_, i) in enumerate(sorted(r for r in rows if r[0] is not None)[:3], 1))


def test_nearby_pool_of_every_place(spark, around):
    want = set()
    for a, rows in around.items():
        there = sorted(r for r in rows if r[0] is not None)
        near = [r for r in there if r[0] <= 10]
        want |= {(a, i) for _, i in (rows if len(there) < 10 else near if len(near) >= 12 else there[:25])}
    got = [tuple(r) for r in plans.QUERIES["nearby_pool"](spark, FOLDER).select("anchor", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_fallback_hits_of_every_part(spark):
    by = defaultdict(list)
    for r in table(spark, FOLDER, "part").collect():
        key = r["p_partkey"]
        by[r["p_size"]].append(((key % 2, key % 3), r["p_retailprice"], key))
    want = {(q, i) for q, rows in by.items() for _, _, i in sorted(x for x in rows if x[0] == min(rows)[0])[:6]}
    assert {tuple(r) for r in plans.QUERIES["fallback_hits"](spark, FOLDER).collect()} == want


def how(name, name_r, affix=None):
    """name_pairs' rules for two names."""
    normal = lambda x: re.sub(r"\s+", "", x).lower()

    def core(x):
        for strip in (str.removesuffix, str.removeprefix):
            if affix and len(x) >= len(affix) + 2:
                x = strip(x, affix)
        return x

    a, b = normal(name), normal(name_r)
    if not a or not b:
        return None
    if a == b:
        return "equal"
    short, tokens = (a, name_r.split()) if len(a) <= len(b) else (b, name.split())
    if len(short) >= 2 and any(short in ("".join(tokens[:k]).lower(), "".join(tokens[-k:]).lower()) for k in range(1, len(tokens) + 1)):
        return "tokens"
    x, y = core(a), core(b)
    lengths = len(x), len(y)
    return "ratio" if min(lengths) >= 0.7 * max(lengths) and SequenceMatcher(None, x, y).ratio() >= 0.8 else None


def test_names_that_differ_in_front_meet(spark):
    left = spark.createDataFrame([(1, "Cafe"), (2, "Xreenhouse"), (3, ""), (4, "ab")], "id long, name string")
    right = spark.createDataFrame([(1, "Blue Cafe"), (2, "Greenhouse"), (3, ""), (4, "abcd")], "id_r long, name_r string")
    assert sorted(map(tuple, resolve.name_pairs(left, right, []).collect())) == [(1, 1, "tokens"), (2, 2, "ratio")]


def test_name_pairs_equal_brute_force(spark):
    pick = random.Random(3)
    names = ["".join(pick.choice("ab c") for _ in range(pick.randint(1, 14))).strip() for _ in range(90)]
    left = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = [tuple(r) for r in resolve.name_pairs(left, left.toDF("id_r", "name_r"), []).collect()]
    want = {(i, j, x) for i, a in enumerate(names) for j, b in enumerate(names) if (x := how(a, b))}
    assert len(got) == len(set(got)) and set(got) == want


def test_fuzzy_names_of_all_parts(spark):
    folder = "/root/testdata/sf0.01"
    groups = defaultdict(list)
    for r in table(spark, folder, "part").collect():
        groups[r["p_brand"], r["p_size"]].append((r["p_partkey"], f"b{r['p_brand'][6:8]}s{r['p_size']} {r['p_name']}"))
    want = {(i, j, x) for rows in groups.values() for i, a in rows for j, b in rows if i < j and (x := how(a, b, "part"))}
    got = {tuple(r) for r in plans.QUERIES["fuzzy_names"](spark, folder).collect()}
    assert got == want and any((i - j) % 2 == 0 for i, j, _ in got)


def test_grid_join_far_north_and_across_the_meridian(spark):
    left = spark.createDataFrame([(1, 70.0, 20.0), (2, 10.0, 179.99), (3, 89.99, 0.0)], "id long, lat double, lng double")
    right = spark.createDataFrame([(1, 70.0, 20.12), (2, 10.0, -179.99), (3, 89.99, 180.0)], "id_r long, lat_r double, lng_r double")
    assert sorted((r["id"], r["id_r"]) for r in geo.within_km(left, right, 5).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_offered_load_deals_a_key_over_buckets(spark):
    pick = random.Random(1)
    start = dt.datetime(1970, 1, 1)
    rows = [(pick.choice("ab"), start + dt.timedelta(microseconds=pick.choice([pick.randint(-9_000_000, 9_000_000), pick.randint(-9, 9) * 1_000_000])), k) for k in range(300)]
    rows += [("a", None, 300), ("a", None, 301)]
    df = lifecycle.offered_load(spark.createDataFrame(rows, "key string, ts timestamp, id long"), 2)
    two = dt.timedelta(seconds=2)
    want = {i: sum(k == key and (t is ts if ts is None or t is None else ts - two < t <= ts) for k, t, _ in rows) for key, ts, i in rows}
    assert {r["id"]: r["load"] for r in df.collect()} == want and df.count() == len(rows)
    assert "__b" in df._jdf.queryExecution().optimizedPlan().toString()
