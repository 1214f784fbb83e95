"""Names in texts, ranks in an order, keys and items at any depth, pictures, retries and the mining pass on small cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from waymark.functions import nested
from waymark.operators import audit, course, gazetteer, images, ranks, resolve, zones
from waymark.plans import shapes

FOLDER = "/root/testdata/sf0.001"
ROWS = [("seoul", "metro", 1, None), ("busan", "metro", 2, "southeast"), ("goyang", "city", 3, "goyang"), ("yang", "city", 4, None), ("seongsu", "spot", 5, "seongdong"), ("seong", "spot", 6, "other")]


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame(ROWS, "word string, kind string, rank int, alias string")


def by_id(df, column):
    return {r[0]: r[column] for r in df.collect()}


def test_hints_prefer_local_names_and_leave_out_where_a_speaker_comes_from(spark, known):
    texts = ["goyangtrip by seoulites", "seoul workers in busan", "seoul people from seoul", "unseoul", "", None, "seoulseoul near", "yanggoyang"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    names = gazetteer.gazetteer(known.filter("kind <> 'spot'"), ["workers", "people", "near"], 8)
    found = gazetteer.region_hints(frame, ["id"], "text", names, "city")
    assert by_id(found, "hints") == {0: ["goyang"], 1: ["busan"], 2: ["seoul"], 3: [], 4: [], 5: [], 6: ["seoul"], 7: ["yang"]}
    assert by_id(found, "kind") == {0: "city", 1: "metro", 2: "metro", 3: None, 4: None, 5: None, 6: "metro", 7: "city"}
    assert by_id(gazetteer.region_hints(frame, ["id"], "text", names, "city", ["goyang", "yang"]), "hints")[0] == ["seoul"]
    empty = gazetteer.gazetteer(known.limit(0))
    assert set(map(str, by_id(gazetteer.region_hints(frame, ["id"], "text", empty, "city"), "hints").values())) == {"[]"}


def test_areas_trim_what_stands_before_a_name_and_fall_back_to_the_longest_inside(spark, known):
    rows = [(0, "gyeonggigoyang 12", "x"), (1, "a yang", "goyang"), (2, "the seongsustreet", None), (3, None, "xseongx"), (4, None, None), (5, "goyangs", "seongsu")]
    frame = spark.createDataFrame(rows, "id int, location string, name string")
    found = gazetteer.areas(frame, ["id"], ["location", "name"], gazetteer.gazetteer(known), "city", "spot")
    assert by_id(found, "area") == {0: "goyang", 1: "yang", 2: "seongdong", 3: "other", 4: None, 5: "seongdong"}


def test_regions_come_from_the_first_name_outside_of_what_is_taken_out(spark, known):
    frame = spark.createDataFrame([(0, "busan, then seoul"), (1, "35 minutes from seoul base, busan"), (2, "none"), (3, None)], "id int, text string")
    found = gazetteer.regions_in_text(frame, ["id"], "text", gazetteer.gazetteer(known), "seoul[a-z ]*base")
    assert by_id(found, "region") == {0: "seoul", 1: "southeast", 2: None, 3: None}


def test_reading_a_text_takes_time_in_proportion_to_its_length(known):
    names = gazetteer.gazetteer(known, ["near"])
    pick = random.Random(1)
    words = [pick.choice(["seoul", "goyangs", "abc", "busan near", "yangyang"]) for _ in range(40_000)]

    def took(n):
        text = " ".join(words[:n])
        began = time.perf_counter()
        names.hints(text, "city", set())
        return time.perf_counter() - began

    took(1000)
    assert min(took(40_000) for _ in range(3)) < 60 * min(took(2_000) for _ in range(3))


def test_addresses(spark):
    rows = [(0, "Seoulcity Mapo-gu x-ro"), (1, "Seo A Bu"), (2, ""), (3, None), (4, "Elsewhere gu")]
    frame = spark.createDataFrame(rows, "id int, a string").select("id", gazetteer.region_of_address(F.col("a"), {"Seo": "west", "Seoul": "capital"}, ["u"]).alias("x"))
    assert {r["id"]: tuple(r["x"]) for r in frame.collect()} == {0: ("capital", "Mapo-gu"), 1: ("west", "Bu"), 2: (None, None), 3: (None, None), 4: (None, "gu")}


def test_numbers_follow_the_order_over_all_partitions(spark):
    rows = [(k * 7919 % 1000, k % 3) for k in range(1000)] + [(None, 0), (None, 1)]
    frame = spark.createDataFrame(rows, "v int, w int").repartition(7)
    found = sorted(ranks.numbered(frame, [F.col("v").desc_nulls_last(), F.col("w")], "k").collect(), key=lambda r: r["k"])
    assert [r["k"] for r in found] == list(range(1, 1003)) and [r["v"] for r in found] == [*range(999, -1, -1), None, None]
    assert ranks.numbered(frame.limit(0), [F.col("v")], "k").count() == 0


@pytest.mark.parametrize("n", [1, 2, 10, 101, 1000])
def test_order_statistics_equal_places_of_the_sorted_column(spark, n):
    pick = random.Random(n)
    values = [round(pick.random() * 50, 1) for _ in range(n)]
    shares = {"low": 0.0, "median": 0.5, "p90": 0.9, "p99": 0.99}
    row = audit.order_statistics(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5), "v", shares).collect()[0]
    assert [row[k] for k in shares] == [sorted(values)[int(n * p)] for p in shares.values()]
    assert row["n"] == n and row["max"] == max(values) and abs(row["mean"] - sum(values) / n) < 1e-3


def test_keys_are_found_at_any_depth_in_the_order_of_the_text(spark):
    deep = "[" * 5000 + '{"k": 1}' + "]" * 5000
    texts = ['{"a": {"k": 1}, "k": 2}', '{"b": {"k": null, "c": {"k": 9}}, "a": [0, {"k": [3]}]}', '{"z": {"k": 1}, "a": {"k": 2}}', "[]", "7", "not json", "", None, deep]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", nested.find_key(F.col("t"), "k").alias("x"))
    found = {r["id"]: (r["x"]["path"], r["x"]["value"]) for r in frame.collect()}
    assert [found[k] for k in range(8)] == [("$.k", "2"), ("$.a[1].k", "[3]"), ("$.z.k", "1"), *[(None, None)] * 5]
    assert nested.first_under({"a": {"b": [{"k": 0}]}}, "k") == ("$.a.b[0].k", 0)


def test_items_of_any_shape(spark):
    texts = ['{"i": [{"a": 1}, {"a": 2}]}', '{"i": {"a": 3}}', '{"i": ""}', '{"i": []}', "{}", '{"i": [', None, '{"i": null}']
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", nested.items_at(F.col("t"), "$.i", "struct<a:int>").alias("x"))
    found = {r["id"]: (None if r["x"]["items"] is None else [i["a"] for i in r["x"]["items"]], r["x"]["malformed"]) for r in frame.collect()}
    assert found == {0: ([1, 2], False), 1: ([3], False), 2: ([], False), 3: ([], False), 4: ([], False), 5: (None, True), 6: (None, False), 7: ([], False)}


def test_no_picture_comes_twice_while_others_are_left(spark):
    pools = {"a": ["a1", "a2"], "b": ["b1"]}
    rows = [(1, 1, 4, "http://own/1.jpg", "b"), (1, 2, 4, " http://own/1.jpg ", "a"), (1, 3, 4, None, "a"), (1, 4, 5, "http://bad.host/x", "a"), (1, 5, None, "short", None), (2, 1, -3, None, "nowhere")]
    frame = spark.createDataFrame(rows, "c int, pos int, id long, url string, pool string")
    found = {(r["c"], r["pos"]): r["image"] for r in images.course_images(frame, ["c"], pools, "a", ["bad.host"]).collect()}
    assert found == {(1, 1): "http://own/1.jpg", (1, 2): "a1", (1, 3): "a2", (1, 4): "a2", (1, 5): "a1", (2, 1): "a2"}


def test_a_search_falls_back_to_the_next_query(spark):
    candidates = spark.createDataFrame([(1, "x", "here"), (2, "y", "here"), (3, "z", None), (4, None, None), (1, "x", "here")], "k int, name string, area string")
    hits = spark.createDataFrame([("x here", 2, 9), ("x here", 1, 8), ("x", 1, 1), ("y", 3, 5), ("z", 1, 7), ("z", 1, 6)], "query string, rank int, id int")
    found = resolve.search_with_retry(candidates, hits, "k", [F.concat_ws(" ", "name", "area"), F.col("name")])
    assert {r["k"]: (r["attempt"], r["query"], r["id"]) for r in found.collect()} == {1: (1, "x here", 8), 2: (2, "y", 5), 3: (1, "z", 6)}


def test_one_pass_counts_what_the_funnel_counts(spark):
    kept, seen = shapes.mining_pass(spark, FOLDER)
    rows = kept.collect()
    counts = seen.get
    assert counts["kept"] == len(rows) > 0 and counts["all"] == 200
    assert sum(n for name, n in counts.items() if name != "all") == 200
    assert sum(1 for name in ("gate", "search", "category", "duplicate") if counts[name]) >= 3


def test_zones_follow_units_asides_homographs_and_regions(spark):
    dim = spark.createDataFrame([("east", ["r1"], ["대구", "광주"], {"대구": ["대구탕"], "광주": ["광주호"]}), ("isle", ["r2"], ["애월"], None), ("any", [], ["양평동"], None)], "zone string, regions array<string>, words array<string>, compounds map<string,array<string>>")
    rows = [
        (1, "r1", "대구광역시", None, "a"), (2, "r1", None, "광주 근교", "b"), (3, "r1", None, "광주호", "c"), (4, "r1", "", "광주호 광주 길", "d"), (5, "r2", "대구", None, "e"),
        (6, None, "대구", None, "f"), (7, "elsewhere", "광주", None, "g"), (8, "r2", "제주시", "애월", "h"), (9, "r2", "애월읍", None, "i"), (10, "r1", "양평군", None, "j"), (11, "r1", None, "양평동 길", "k"), (12, "r2", "애월시", "x", "l"),
    ]
    places = spark.createDataFrame(rows, "id int, region string, area string, location string, name string")
    found = sorted((r["id"], r["zone"]) for r in zones.in_zones(places, dim, ["근교", "출발"]).collect())
    assert found == [(1, "east"), (4, "east"), (6, "east"), (7, "east"), (9, "isle"), (11, "any"), (12, "isle")]


def test_courses_of_odd_requests(spark):
    places = spark.createDataFrame([(1, "day", "R", "a", 37.0, 127.0, ["m"]), (2, "day", "S", "b", None, None, None), (3, "night", "R", "a", 37.001, 127.0, ["m"]), (4, "stay", "R", "c", 37.5, 127.5, [])], "id long, slot string, region string, area string, lat double, lng double, moods array<string>")
    rows = [(1, 5, 0, "day", ["R"], None), (1, 5, 1, "night", ["R"], "m"), (1, 5, 2, "stay", [], None), (2, 5, 0, "day", ["R", "S"], None), (3, 5, 0, "day", ["Q"], None), (4, 5, 0, "day", ["R"], "none such")]
    requests = spark.createDataFrame(rows, "request_id long, seed long, pos int, slot string, regions array<string>, mood string")
    found = {(r["request_id"], r["pos"]): (r["id"], r["tier"]) for r in course.assemble(requests, places).collect()}
    assert found[1, 0] == (1, 0) and found[1, 1] == (3, 1) and found[1, 2] == (4, 4)
    assert found[2, 0][0] in (1, 2) and found[3, 0] == (None, None) and found[4, 0] == (None, None)
    assert course.assemble(requests, places.limit(0)).filter("id is not null").count() == 0


def test_hints_read_no_occurrences_inside_words(monkeypatch):
    """A run's head is looked up and checked where it stands; occurrences elsewhere count only if that one is marked."""
    monkeypatch.setattr(gazetteer.Gazetteer, "occurrences", lambda *_: pytest.fail("all occurrences were read"))
    names = gazetteer.Gazetteer(["an", "anan", "bcd", "bc"], ["metro", "local", "local", "metro"], [None] * 4, [None] * 4, ["the"], 5, "[a-z]+")
    assert names.hints("anan the xanan, bcd the", "local", set()) == (["anan"], "local")  # free inside a word
    assert names.hints("anananan the, bcde", "local", {"bcd"}) == (["anan"], "local")  # the second of the two that don't overlap is marked
    assert names.hints("bcd the anan the", "local", set()) == ([], None)
    assert names.hints("bcd the an then anx", "local", set()) == (["an"], "metro")
    assert names.hints("", "local", set()) == names.hints(None, "local", set()) == ([], None)
