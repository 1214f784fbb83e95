"""What is moved between tasks must not grow with pairs of copies."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import audit, course, pools, resolve

COPIES = 1500


@pytest.fixture
def moved(spark):
    """Rows shuffled and written by what runs between two calls."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def rows() -> int:
        none = spark._jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, gateway.new_array(spark._jvm.double, 0), none).iterator()
        total = 0
        while stages.hasNext():
            stage = stages.next()
            total += stage.shuffleWriteRecords() + stage.outputRecords()
        return total

    return rows


@pytest.fixture(scope="module")
def copies(spark):
    """Places of two points and one that has no coordinates, all in one area."""
    return spark.range(COPIES).selectExpr("id", "'a' AS area", "CASE WHEN id > 0 THEN 35.0 + id % 2 / 100 END AS lat", "CASE WHEN id > 0 THEN 127.0D END AS lng").withColumn("lat", F.col("lat").cast("double"))


def test_nearby_pools_of_copies_shuffle_no_pairs(spark, copies, moved):
    before = moved()
    others = copies.selectExpr("id", "area", "lat AS lat_r", "lng AS lng_r")
    pairs = course.nearby_pool_on_grid(copies.withColumnRenamed("id", "anchor"), others, ["area"])
    assert pairs.count() == (COPIES - 1) * (COPIES - 2) + COPIES - 1
    assert moved() - before < 60 * COPIES


def test_nearest_of_copies_shuffles_no_pairs(spark, copies, moved):
    before = moved()
    others = copies.selectExpr("id", "area", "lat AS lat_r", "lng AS lng_r")
    got = course.nearest_on_grid(copies.withColumnRenamed("id", "anchor"), others, ["area"]).collect()
    assert sorted((r["rank"], r["id"], r["km"]) for r in got if r["anchor"] == 5) == [(1, 1, 0.0), (2, 3, 0.0), (3, 7, 0.0)]
    assert len(got) == 3 * (COPIES - 1) and moved() - before < 60 * COPIES


def test_copies_within_km_meet_as_points(spark, copies):
    pairs = geo.pairs_within_km(copies, copies.selectExpr("id AS id_r", "lat AS lat_r", "lng AS lng_r"), 1, digits=3)
    assert pairs.count() == sum(sum(i % 2 == k for i in range(1, COPIES)) ** 2 for k in (0, 1))
    assert {(r["km"], (r["id"] - r["id_r"]) % 2) for r in pairs.filter("id < 20 and id_r < 20").collect()} == {(0.0, 0)}


def test_arrays_taken_apart_together_are_short(spark, monkeypatch):
    """A task holds all rows of two arrays at once, so that their lengths bound its memory."""
    gathered, longest = geo.gathered, {}

    def noted(df, by, of, name, *more):
        out = gathered(df, by, of, name, *more)
        longest[name] = out.agg(F.max(F.size(name))).first()[0]
        return out

    monkeypatch.setattr(geo, "gathered", noted)
    monkeypatch.setattr(course, "gathered", noted)
    near = spark.range(9000).selectExpr("id", "'a' AS area", "35.0D AS lat", "127.0D AS lng")
    geo.pairs_within_km(near, near.selectExpr("id AS id_r", "lat AS lat_r", "lng AS lng_r"), 1)
    assert longest["ids"] * longest["ids_r"] < 300_000
    course.everyone(spark.range(90_000).selectExpr("id AS anchor", "'a' AS area"), spark.range(90_000).selectExpr("id", "'a' AS area"), ["area"])
    assert longest["anchors"] * longest["ids"] < 300_000


@pytest.fixture(scope="module")
def asked(spark):
    """Requests of one region; those of even numbers want area a0, the others an area without places."""
    return spark.range(200).selectExpr("id AS request_id", "0 AS pos", "'stay' AS slot", "array('r') AS regions", "CAST(NULL AS string) AS mood", "IF(id % 2 = 0, 'a0', 'none') AS wanted_area", "IF(id % 4 < 2, 35.0D, NULL) AS anchor_lat", "127.0D AS anchor_lng")


@pytest.fixture(scope="module")
def rooms(spark):
    return spark.range(300).selectExpr("id", "'stay' AS slot", "'r' AS region", "concat('a', id % 3) AS area", "array('x') AS moods", "IF(id % 5 > 0, 35.0D + id % 2, NULL) AS lat", "127.0D AS lng")


def test_wanted_areas_shuffle_no_pairs(spark, asked, rooms, moved):
    before = moved()
    got = {tuple(r) for r in pools.in_wanted_area(asked, rooms, ["request_id", "slot"], pools.beyond_km(20)).select("request_id", "id", "relaxed").collect()}
    near = lambda q, i: q % 4 < 2 and i % 5 > 0 and i % 2 == 0
    assert got == {(q, i, q % 2 == 1) for q in range(200) for i in range(300) if (i % 3 == 0 if q % 2 == 0 else near(q, i))}
    assert moved() - before < 60 * 500


def test_places_seen_are_left_out_without_pairs(spark, asked, rooms, moved):
    before = moved()
    seen = spark.createDataFrame([(3, 7), (3, 7), (3, 8), (999, 1), (4, None), *((5, i) for i in range(300))], "request_id long, id int")
    held = {(3, 7), (3, 8), *((5, i) for i in range(300))}
    want = {(q, i) for q in range(200) for i in range(300)} - held
    assert {tuple(r) for r in pools.not_seen(asked, rooms, seen).select("request_id", "id").collect()} == want
    got = [tuple(r) for r in pools.not_seen(asked, rooms, seen, ["request_id", "slot"]).select("request_id", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == want | {(5, i) for i in range(300)}
    assert moved() - before < 100 * 500


@pytest.mark.parametrize("unless_empty", [None, ["request_id", "slot"]])
def test_requests_that_saw_nothing_are_dealt_once(spark, asked, rooms, moved, unless_empty):
    """A request's row for each part of a pool is shuffled once; ids seen that are in no pool of their request are not kept."""
    before = moved()
    seen = spark.range(3000).selectExpr("5 AS request_id", "id + 1 AS id").union(spark.range(1).selectExpr("6 AS request_id", "-1L AS id"))
    other = rooms.withColumn("slot", F.when(F.col("id") == 0, "day").otherwise("stay"))
    got = [tuple(r) for r in pools.not_seen(asked, other, seen, unless_empty).select("request_id", "id").collect()]
    want = {(q, i) for q in range(200) for i in range(1, 300) if q != 5 or unless_empty}
    assert len(got) == len(set(got)) and set(got) == want
    assert moved() - before < 1.5 * 200 * pools.PARTS + 2000


def test_copies_of_names_are_compared_once(spark, moved):
    before = moved()
    names = spark.range(600).selectExpr("id", "'g' AS g", "element_at(array('blue cafe', 'blue cafes', 'cafe'), CAST(id % 3 + 1 AS int)) AS name")
    got = [tuple(r) for r in resolve.name_pairs(names, names.withColumnsRenamed({"id": "id_r", "name": "name_r"}), [], on=["g"], ascending=True).collect()]
    how = {(0, 0): "equal", (1, 1): "equal", (2, 2): "equal", (0, 1): "ratio", (1, 0): "ratio", (0, 2): "tokens", (2, 0): "tokens"}
    assert len(got) == len(set(got)) and set(got) == {(i, j, how[i % 3, j % 3]) for i in range(600) for j in range(i + 1, 600) if (i % 3, j % 3) in how}
    assert moved() - before < 60 * 600


def test_cube_counts_without_moving_sets(spark, moved):
    before = moved()
    rows = spark.range(4000).selectExpr("id % 2000 AS id", "'day' AS slot", "IF(id % 2000 = 0, NULL, IF(id < 2000, 'r', 's')) AS region", "IF(id % 2000 = 1, NULL, array('x', 'y', 'z', 'x')) AS moods")
    got = {(r["region"], r["mood"]): r["n"] for r in audit.candidate_cube(rows).collect()}
    assert got == {(r, m): 2000 - (r != "ALL") - (m != "ALL") for r in ("r", "s", "ALL") for m in ("x", "y", "z", "ALL")}
    assert moved() - before < 3 * 4000


@pytest.mark.parametrize("expected", [0, 3, 64])  # no hash, few and all of the small pools fall below a bound
def test_near_draws_sort_no_arrays_of_places(spark, monkeypatch, expected):
    plans, cut = [], course.cut

    def noted(df):
        plans.append(spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
        return cut(df)

    monkeypatch.setattr(course, "cut", noted)
    places = spark.range(900).selectExpr("id", "'day' AS slot", "'r' AS region", "concat('a', id % 2) AS area", "array('x') AS moods", "IF(id % 7 > 0, 35 + id % 30 / 100D, NULL) AS lat", "127.0D AS lng")
    ranked = course.rank_pools(places)
    steps = spark.range(120).selectExpr("id DIV 2 AS request_id", "CAST(id % 2 AS int) AS pos", "'day' AS slot", "IF(id < 4, NULL, id DIV 2) AS seed", "IF(id % 3 > 0, 'r', '*') AS r", "'*' AS m", "CASE WHEN id % 8 > 1 THEN 35 + id % 8 / 100D WHEN id % 8 = 1 THEN 60.0D END AS lat", "127.0D AS lng")
    plans.clear()
    found = course.drawn_near(steps, ranked, 5) if expected == 64 else course.drawn_near(steps, ranked, 5, expected)
    noted(found)
    sorts = [line for plan in plans for head, line in zip(plan.splitlines(), plan.splitlines()[1:], strict=False) if head.endswith(") Sort")]
    assert sorts and not [line for line in sorts if "ids#" in line and "lat_r#" in line and ("seed#" in line or "start" in line)]
    lat = lambda i: 35 + i % 30 / 100
    want = {}
    for i in range(120):
        at = {1: 60.0}.get(i % 8, 35 + i % 8 / 100)
        near = [p for p in range(900) if i % 8 and p % 7 and math.radians(abs(lat(p) - at)) * geo.EARTH_KM <= 5]
        if near:
            want[i // 2, i % 2] = min(near, key=lambda p: hashlib.md5(f"{i // 2}-{p}".encode() if i >= 4 else str(p).encode()).hexdigest())
    assert {(r["request_id"], r["pos"]): r["id"] for r in found.collect()} == want and len(want) == 90
    assert all(r["lat"] == lat(r["id"]) and r["area"] == f"a{r['id'] % 2}" for r in found.collect())
