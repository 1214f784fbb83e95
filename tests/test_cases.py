"""Hand-written cases."""

import datetime as dt
from collections import deque

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, scoring, text
from waymark.operators import course, lifecycle, mining, pools, repair, resolve
from waymark.sources import markdown
from waymark.sources import places as place_source
from waymark.streaming import rate, state


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def test_score_bands(spark):
    rows = [(v, False, None, False) for v in (2_999, 3_000, 10_000, 50_000, 100_000)]
    got = values(spark, scoring.hot_score(F.col("v"), F.col("s"), F.col("r"), F.col("ok"))["hot"], rows, "v long, s boolean, r double, ok boolean")
    assert got == [15 + 35, 20 + 35, 28 + 35, 35 + 35, 40 + 35]


def test_human_numbers(spark):
    assert values(spark, text.human_number(F.col("x")), [("15만",), ("3.5천",), ("1.2M",), ("45,120",), ("none",), (None,)], "x string") == [150_000, 3_500, 1_200_000, 45_120, None, None]


def test_masked_words_and_areas(spark):
    assert values(spark, text.contains_masked(F.col("x"), "스테이", ["스테이크", "스테이션"]), [("스테이크",), ("한옥스테이",), (None,)], "x string") == [False, True, False]
    pairs = [("강남구", "강남구"), ("양평군", "양평"), ("양평읍", "양평"), ("가평군", "양평"), (None, "양평")]
    assert values(spark, text.area_is_keyword(F.col("a"), F.col("k")), pairs, "a string, k string") == [True, True, True, False, False]


@pytest.mark.parametrize(("said", "want"), [("서울 강남구 역삼동", ("ok", "SEOUL", "강남구")), ("서울", ("no_area", "SEOUL", None)), ("경기 성남시 분당구", ("ok", "GYEONGGI", "성남시")), ("elsewhere", ("unparseable", None, None)), ("", ("no_address", None, None)), (None, ("no_address", None, None))])
def test_addresses(spark, said, want):
    provinces = [(["서울"], "SEOUL", True), (["경기"], "GYEONGGI", False)]
    assert tuple(values(spark, repair.parse_address(F.col("x"), provinces), [(said,)], "x string")[0]) == want


def test_time_slots(spark):
    assert values(spark, F.array_join(text.time_slots(F.col("h")), "+"), [(4,), (5,), (13,), (14,), (19,), (20,)], "h int") == ["night+stay", "day+evening", "day+evening", "evening+night", "evening+night", "night+stay"]


def test_travel_modes(spark):
    got = values(spark, geo.travel(F.col("km")), [(0.01,), (0.5,), (1.0,), (29.9,), (30.0,), (None,)], "km double")
    assert [tuple(x) for x in got] == [("walk", 1.0), ("walk", 8.0), ("drive", 5.0), ("drive", 75.0), ("hours", 0.5), (None, None)]


def test_links_decode(spark):
    links = spark.createDataFrame([(1, "3.1.2"), (2, "x.1"), (3, "0.4"), (4, None)], "request_id long, link string")
    assert sorted(tuple(r) for r in course.decode_link(links).collect()) == [(1, 0, 3), (1, 1, 1), (1, 2, 2), (3, 1, 4)]


def test_relaxation_keeps_all_rows_of_groups_without_a_hit(spark):
    pool = spark.createDataFrame([(1, True), (1, False), (2, False), (2, None)], "g long, ok boolean")
    got = sorted((r["g"], r["relaxed"]) for r in pools.keep_unless_empty(pool, F.col("ok"), ["g"]).collect())
    assert got == [(1, False), (2, True), (2, True)]


def test_grid_join_equals_brute_force(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    places = spark.range(300).select("id", (33 + F.rand(1) * 0.5).alias("lat"), (126 + F.rand(2) * 0.5).alias("lng")).checkpoint()
    other = places.select(F.col("id").alias("id_r"), F.col("lat").alias("lat_r"), F.col("lng").alias("lng_r"))
    grid = {(r[0], r[1]) for r in geo.within_km(places, other, 3).select("id", "id_r").collect()}
    rows = places.collect()
    want = places.crossJoin(other).filter(geo.haversine_km(F.col("lat"), F.col("lng"), F.col("lat_r"), F.col("lng_r")) <= 3)
    assert grid == {(r["id"], r["id_r"]) for r in want.collect()} and len(grid) > len(rows)


def test_name_pairs(spark):
    left = spark.createDataFrame([(1, "Blue Cafe"), (2, "Blue Cafe Annex"), (3, "Greenhouse dining"), (4, "Sol")], "id long, name string")
    right = spark.createDataFrame([(1, "blue-cafe"), (2, "Greenhouse dinning"), (3, "Solaris")], "id_r long, name_r string")
    got = sorted(tuple(r) for r in resolve.name_pairs(left, right, []).collect())
    assert got == [(1, 1, "equal"), (2, 1, "tokens"), (3, 2, "ratio")]


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def test_rate_limit_edges():
    log = deque()
    assert [rate.admit(log, k * 2_000_000)[0] for k in range(26)] == [True] * 25 + [False]
    assert len(log) == 25  # refused requests do not count
    assert rate.admit(log, 60_000_000)[0]  # an event exactly 60 s old is outside


def test_admission_stream_equals_batch(spark, tmp_path):
    limits = [(3, 60_000_000, "minute"), (10, 600_000_000, "hour")]
    rows = [(f"k{k % 3}", k, at(k * 7)) for k in range(200)]
    spark.createDataFrame(rows, "key string, id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = rate.admission(spark.read.parquet(str(tmp_path / "in")), limits)
    source = spark.readStream.schema("key string, id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = rate.admission_stream(source, limits).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert {tuple(r) for r in spark.table("admitted").collect()} == {tuple(r) for r in batch.collect()}


def test_closure_stream_equals_batch(spark, tmp_path):
    seen = [1, 0, 0, 1, 0, 0, 0, 1, 0]
    rows = [(k, at(i), i, bool(f)) for k in (1, 2) for i, f in enumerate(seen[: 9 if k == 1 else 6])]
    events = spark.createDataFrame(rows, "key long, ts timestamp, id long, found boolean")
    batch = {r["key"]: (r["fails"], r["closed"], r["n"]) for r in lifecycle.closure(events).collect()}
    assert batch == {1: (3, True, 7), 2: (2, False, 6)}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = state.closure_stream(source).writeStream.format("memory").queryName("closed").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert {r["key"]: (r["fails"], r["closed"], r["n"]) for r in spark.table("closed").collect()} == batch


def test_sections_and_fields(spark):
    guide = "# Guide\n## Hall A\n**Price**: 10\nnice\n## Hall B\n### Note\nx\n## Tips for all\n### Inner\nskip me"
    docs = spark.createDataFrame([("p", guide), ("q", None)], "path string, content string")
    rows = markdown.sections(docs, ["Tips"]).collect()
    assert [(r["title"], r["level"]) for r in rows] == [("Hall A", 2), ("Hall B", 2), ("Note", 3)]
    fields = markdown.sections(docs, ["Tips"]).select(markdown.labelled_field(F.col("body"), ["Price"]).alias("p")).collect()
    assert [r[0] for r in fields] == ["10", None, None]
    assert values(spark, F.array_join(markdown.front_matter_tags(F.col("x")), "+"), [("---\ntags: [a, 'b']\n---\nz",), ("---\ntags:\n- c\n- d\n---\n",), ("no",)], "x string") == ["a+b", "c+d", ""]


def test_read_places_and_policies(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"id": 1, "name": "A", "slot": "day", "is_closed": true}, {"id": 2, "name": "B", "slot": "noon"}, {"id": 3, "slot": null}]')
    rows = place_source.read_json(spark, str(tmp_path / "p.json"))
    assert [r["id"] for r in place_source.active(rows).orderBy("id").collect()] == [2, 3]
    good, bad = place_source.split_valid(rows, {"slot": ["day", "evening", "night", "stay"]}, ["name"])
    assert [r["id"] for r in good.collect()] == [1]
    assert {(r["id"], r["reason"]) for r in bad.collect()} == {(2, "slot not allowed"), (3, "name missing")}


def test_name_gate(spark):
    got = values(spark, mining.name_gate(F.col("x"), ["the"])["reason"], [("Blue hall",), ("",), ("What a day.",), ("(open",), ("a#b",), ("x",), ("12 34",), ("a b c d e",), ("over the top",), (None,)], "x string")
    assert got == [None, "empty", "sentence", "brackets", "symbols", "length", "letters", "tokens", "stopword", "empty"]
