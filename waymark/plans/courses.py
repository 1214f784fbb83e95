"""Queries about pools and courses. Suppliers stand for requests, customers for places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import gates
from waymark.functions.geo import box_regions, pairs_within_km
from waymark.operators import audit, course, lifecycle, pools
from waymark.plans.registry import query
from waymark.sources.tables import PLACES_SQL, SLOTS, places, table

HEADINGS, MEDIA = [r"00$"], ["#000000077", "#000000177"]
ELIGIBLE_SQL = f"""{PLACES_SQL}, pool AS (SELECT * FROM (SELECT *, CASE WHEN balance > 7500 THEN '90 by hour, 200 per night' WHEN balance > 5000 THEN '120 per night' WHEN balance > 2500 THEN 'Room with meal' WHEN balance > 0 THEN 'room, meal by hour' END AS price FROM spots) z WHERE name NOT LIKE '%00' AND name NOT LIKE '%#000000077%' AND name NOT LIKE '%#000000177%'
  AND (slot <> 'stay' OR CASE WHEN category = 'MACHINERY' THEN FALSE WHEN price LIKE '%per night%' OR lower(price) LIKE '%room%' AND price LIKE '%meal%' AND price NOT LIKE '%by hour%' THEN TRUE WHEN lat IS NULL THEN FALSE ELSE balance > 0 END))"""
REQUESTS_SQL = """requests AS (SELECT s_suppkey AS request_id, s_suppkey AS seed, r_name AS wanted, n_name AS wanted_area,
  CASE WHEN s_suppkey % 4 = 0 THEN 'quiet' END AS mood, p AS pos, CASE p WHEN 0 THEN 'evening' WHEN 1 THEN 'day' WHEN 2 THEN 'stay' ELSE 'night' END AS slot
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, (SELECT unnest([0, 1, 2, 3]) AS p) x)"""
KM_SQL = "2 * 6371e0 * atan2(sqrt({a}), sqrt(1 - {a}))"


def km_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    return KM_SQL.format(a=a)


def offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eligible places."""
    balance = F.col("balance")
    price = F.when(balance > 7500, "90 by hour, 200 per night").when(balance > 5000, "120 per night").when(balance > 2500, "Room with meal").when(balance > 0, "room, meal by hour")
    nightly = gates.lodging_price(F.col("price"), "per night", "by hour", ["room", "meal"])
    rules = [(F.col("category") == "MACHINERY", False), (nightly, True), (F.col("lat").isNull(), False), (balance > 0, True)]
    return pools.eligible(places(spark, sf_dir).withColumn("price", price), SLOTS, HEADINGS, MEDIA, rules)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, seed, pos, slot, regions, wanted, wanted_area, mood of four steps a supplier."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    steps = F.posexplode(F.array(*map(F.lit, ["evening", "day", "stay", "night"]))).alias("pos", "slot")
    wide = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return wide.select(F.col("s_suppkey").alias("request_id"), F.col("s_suppkey").alias("seed"), F.array("r_name").alias("regions"), F.col("r_name").alias("wanted"), F.col("n_name").alias("wanted_area"), F.when(F.col("s_suppkey") % 4 == 0, "quiet").alias("mood"), steps)


def free_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses of day, day and night; those of every third supplier may lie anywhere."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    steps = F.posexplode(F.array(*map(F.lit, ["day", "day", "night"]))).alias("pos", "slot")
    wide = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    regions = F.when(F.col("s_suppkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("r_name"))
    return wide.select(F.col("s_suppkey").alias("request_id"), F.col("s_suppkey").alias("seed"), regions.alias("regions"), F.col("r_name").alias("wanted"), F.lit(None).cast("string").alias("mood"), steps)


def free_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course.assemble(free_requests(spark, sf_dir), offered(spark, sf_dir))


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id and id of the places that a request's last courses had: orders stand for them."""
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("request_id"), F.col("o_custkey").alias("id"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course.assemble(requests(spark, sf_dir), offered(spark, sf_dir))


FREE_REQUESTS_SQL = """requests AS (SELECT s_suppkey AS request_id, s_suppkey AS seed, r_name AS wanted, n_name AS wanted_area, s_suppkey % 3 = 0 AS free, NULL AS mood, p AS pos, CASE p WHEN 2 THEN 'night' ELSE 'day' END AS slot
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, (SELECT unnest([0, 1, 2]) AS p) x)"""


def candidates_sql(requests: str, meets: str) -> str:
    """cand: the places p that meet a request q, with the hash and the number that its seed draws by."""
    return f"""{ELIGIBLE_SQL}, {requests}, cand AS (SELECT q.request_id, q.seed, q.pos, q.slot, q.wanted_area, p.id, p.area, p.region, p.lat, p.lng,
  md5(concat(q.seed, '-', p.id)) AS h, ('0x' || substr(md5(concat(q.seed, '-', q.pos)), 1, 8))::BIGINT AS d FROM requests q JOIN pool p ON p.slot = q.slot AND {meets} WHERE q.mood IS NULL OR list_contains(p.moods, q.mood))"""


def anchor_sql(candidates: str) -> str:
    return f"""{candidates}, sizes AS (SELECT request_id, slot, pos, count(*) AS n FROM cand GROUP BY ALL),
  anchor_at AS (SELECT * FROM sizes QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY n, pos) = 1)"""


CANDIDATES_SQL = candidates_sql(REQUESTS_SQL, "p.region = q.wanted")
ANCHOR_SQL = anchor_sql(CANDIDATES_SQL)


def tiers_sql(name: str, pairs: str) -> str:
    """name: the tiered choice among pairs (request_id, pos, slot, id, area, region, lat, lng, h, a_area, a_region, km)."""
    return f"""{name}_ranked AS (SELECT *, CASE WHEN km <= 5 THEN 1 WHEN area = a_area THEN 2 WHEN km <= 10 THEN 3 END AS t,
    row_number() OVER (PARTITION BY request_id, pos, area ORDER BY id) - 1 = d % count(*) OVER (PARTITION BY request_id, pos, area) AS area_hit,
    row_number() OVER (PARTITION BY request_id, pos ORDER BY area, id) - 1 = d % count(*) OVER (PARTITION BY request_id, pos) AS pool_hit,
    CASE WHEN km IS NOT NULL THEN row_number() OVER (PARTITION BY request_id, pos ORDER BY km NULLS LAST, id) END AS any_rank,
    CASE WHEN km IS NOT NULL AND region = a_region THEN row_number() OVER (PARTITION BY request_id, pos, region = a_region ORDER BY km NULLS LAST, id) END AS own_rank FROM ({pairs}) z),
  {name} AS (SELECT request_id, pos, slot, tier, id, area, region, lat, lng, km FROM (SELECT *, coalesce(t, CASE WHEN own_rank <= 3 THEN 4 WHEN any_rank <= 3 THEN 4.5 ELSE 5 END) AS tier0, CASE WHEN t IS NOT NULL THEN t WHEN own_rank <= 3 OR any_rank <= 3 THEN 4 ELSE 5 END AS tier FROM {name}_ranked) z
    QUALIFY row_number() OVER (PARTITION BY request_id, pos ORDER BY tier0, CASE WHEN tier0 = 2 AND NOT area_hit OR tier0 = 5 AND NOT pool_hit THEN 1 ELSE 0 END, h, id) = 1)"""


def course_sql(anchors_and_candidates: str) -> str:
    """steps: the whole course of every request."""
    return f"""WITH {anchors_and_candidates}, anchors AS (SELECT c.request_id, c.pos, c.slot, id, area, region, lat, lng FROM cand c JOIN anchor_at a ON a.request_id = c.request_id AND a.pos = c.pos
    QUALIFY row_number() OVER (PARTITION BY c.request_id ORDER BY area, id) - 1 = d % count(*) OVER (PARTITION BY c.request_id)),
  around AS (SELECT c.*, a.area AS a_area, a.region AS a_region, a.lat AS a_lat, a.lng AS a_lng FROM cand c JOIN anchors a ON a.request_id = c.request_id AND a.pos <> c.pos),
  {tiers_sql("plain", f"SELECT *, {km_sql('a_lat', 'a_lng', 'lat', 'lng')} AS km FROM around WHERE slot <> 'stay'")},
  located AS (SELECT request_id, lat AS b_lat, lng AS b_lng FROM (SELECT request_id, -1 AS pos, lat, lng FROM anchors UNION ALL SELECT request_id, pos, lat, lng FROM plain) z WHERE lat IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY pos) = 1),
  {tiers_sql("lodging", f"SELECT o.*, {km_sql('b_lat', 'b_lng', 'lat', 'lng')} AS km FROM around o LEFT JOIN located l ON l.request_id = o.request_id WHERE slot = 'stay'")},
  picked AS (SELECT * FROM plain UNION ALL SELECT * FROM lodging UNION ALL SELECT request_id, pos, slot, 0, id, area, region, lat, lng, 0e0 FROM anchors),
  steps AS (SELECT q.request_id, q.pos, q.slot, q.wanted, k.tier, k.id, k.area, k.region, k.lat, k.lng, k.km FROM requests q LEFT JOIN picked k ON k.request_id = q.request_id AND k.pos = q.pos)"""


COURSE_SQL = course_sql(ANCHOR_SQL)
#: The same of free_requests().
FREE_SQL = course_sql(anchor_sql(candidates_sql(FREE_REQUESTS_SQL, "(q.free OR p.region = q.wanted)")))
LEGS_SQL = f"""{COURSE_SQL}, ahead AS (SELECT request_id, pos, slot, id, lat, lng, lead(id) OVER w AS next_id, lead(lat) OVER w AS b_lat, lead(lng) OVER w AS b_lng FROM steps WHERE id IS NOT NULL WINDOW w AS (PARTITION BY request_id ORDER BY pos)),
  legs AS (SELECT request_id, pos, slot, id, next_id, {km_sql("lat", "lng", "b_lat", "b_lng")} AS km FROM ahead)"""


@query(f"{LEGS_SQL} SELECT request_id, pos, slot, id, next_id, round(km, 3) AS km, CASE WHEN km < 1 THEN 'walk' WHEN km < 30 THEN 'drive' WHEN km IS NOT NULL THEN 'hours' END AS mode, CASE WHEN km < 1 THEN greatest(1e0, floor(km * 15 + 0.5)) WHEN km < 30 THEN greatest(3e0, floor(km / 25 * 60 + 3 + 0.5)) ELSE floor(km / 60 * 10 + 0.5) / 10 END AS amount FROM legs")
def course_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course.legs(steps(spark, sf_dir)).withColumn("km", F.round("km", 3))


@query(f"{COURSE_SQL} SELECT request_id, pos, slot, tier, id FROM steps")
def course_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).select("request_id", "pos", "slot", "tier", "id")


@query(f"WITH {ELIGIBLE_SQL} SELECT id, slot, region FROM pool")
def eligible_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offered(spark, sf_dir).select("id", "slot", "region")


@query(f"WITH {PLACES_SQL} SELECT id, region FROM spots WHERE region IN ('ASIA', 'EUROPE')")
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).filter(pools.in_regions(F.col("region"), ["ASIA", "EUROPE"])).select("id", "region")


@query(f"WITH {PLACES_SQL} SELECT id FROM spots WHERE list_contains(moods, 'quiet')")
def mood_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).filter(pools.has_mood(F.col("moods"), "quiet")).select("id")


ZONE_SQL = f"{CANDIDATES_SQL}, flagged AS (SELECT *, max(area = wanted_area) OVER (PARTITION BY request_id, slot) AS has_one FROM cand)"


@query(f"WITH {ZONE_SQL} SELECT request_id, slot, id, NOT has_one AS relaxed FROM flagged WHERE area = wanted_area OR NOT has_one")
def zone_relax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.in_wanted_area(requests(spark, sf_dir), offered(spark, sf_dir), ["request_id", "slot"]).select("request_id", "slot", "id", "relaxed")


@query(f"""WITH {ZONE_SQL}, kept AS (SELECT *, NOT has_one AS relaxed FROM flagged WHERE area = wanted_area OR NOT has_one)
SELECT k.request_id, k.slot, k.id FROM kept k LEFT JOIN (SELECT id AS anchor_id, lat AS a_lat, lng AS a_lng FROM spots) a ON a.anchor_id = k.request_id
WHERE k.slot <> 'stay' OR NOT relaxed OR coalesce({km_sql("a_lat", "a_lng", "lat", "lng")} <= 20, FALSE)""")
def lodging_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = places(spark, sf_dir).select(F.col("id").alias("request_id"), F.col("lat").alias("anchor_lat"), F.col("lng").alias("anchor_lng"))
    asked = requests(spark, sf_dir).join(anchors, "request_id", "left")
    return pools.in_wanted_area(asked, offered(spark, sf_dir), ["request_id", "slot"], pools.beyond_km(20)).select("request_id", "slot", "id")


@query(f"""WITH {CANDIDATES_SQL}, marked AS (SELECT c.*, o.id IS NULL AS fresh FROM cand c LEFT JOIN (SELECT DISTINCT o_orderkey % 100 AS request_id, o_custkey AS id FROM orders) o ON o.request_id = c.request_id AND o.id = c.id),
  flagged AS (SELECT *, max(fresh) OVER (PARTITION BY request_id, slot) AS has_one FROM marked) SELECT request_id, slot, id FROM flagged WHERE fresh OR NOT has_one""")
def recent_soft_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.not_seen(requests(spark, sf_dir), offered(spark, sf_dir), recent(spark, sf_dir), ["request_id", "slot"]).select("request_id", "slot", "id")


@query(f"WITH {CANDIDATES_SQL} SELECT request_id, slot, id FROM cand c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.id AND o.o_orderkey % 100 = c.request_id)")
def hard_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.not_seen(requests(spark, sf_dir), offered(spark, sf_dir), recent(spark, sf_dir)).select("request_id", "slot", "id")


@query(f"WITH {ANCHOR_SQL} SELECT request_id, slot, pos, n FROM anchor_at")
def anchor_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course.smallest_pools(course.asked_pools(requests(spark, sf_dir), course.rank_pools(offered(spark, sf_dir)).sizes))


@query(f"WITH {CANDIDATES_SQL} SELECT request_id, slot, id FROM cand QUALIFY row_number() OVER (PARTITION BY request_id, slot ORDER BY area, id) - 1 = d % count(*) OVER (PARTITION BY request_id, slot)")
def seeded_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = course.rank_pools(offered(spark, sf_dir))
    asked = course.asked_pools(requests(spark, sf_dir), pools.sizes)
    return course.drawn_place(asked, pools.places, "at", course.POOL).select("request_id", "slot", "id")


def everywhere(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All places as anchors (anchor, area, lat, lng) and as others (id, area, lat_r, lng_r)."""
    p = places(spark, sf_dir)
    return p.select(F.col("id").alias("anchor"), "area", "lat", "lng"), p.select("id", "area", F.col("lat").alias("lat_r"), F.col("lng").alias("lng_r"))


PAIRS_SQL = f"""{PLACES_SQL}, pairs AS (SELECT a.id AS anchor, b.id, {km_sql("a.lat", "a.lng", "b.lat", "b.lng")} AS km FROM spots a JOIN spots b ON a.area = b.area AND a.id <> b.id)"""


@query(f"WITH {PAIRS_SQL} SELECT anchor, id, round(km, 3) AS km, row_number() OVER (PARTITION BY anchor ORDER BY km, id) AS rank FROM pairs WHERE km IS NOT NULL QUALIFY rank <= 3")
def nearest3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course.nearest_on_grid(*everywhere(spark, sf_dir), ["area"]).withColumn("km", F.round("km", 3))


@query(f"""WITH {PAIRS_SQL}, c AS (SELECT *, count(km) OVER (PARTITION BY anchor) AS located, count(*) FILTER (km <= 10) OVER (PARTITION BY anchor) AS near, row_number() OVER (PARTITION BY anchor ORDER BY km NULLS LAST, id) AS rank FROM pairs)
SELECT anchor, id FROM c WHERE located < 10 OR (near >= 12 AND km <= 10) OR (near < 12 AND rank <= 25 AND km IS NOT NULL)""")
def nearby_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course.nearby_pool_on_grid(*everywhere(spark, sf_dir), ["area"])


@query(f"WITH {PLACES_SQL} SELECT a.id, b.id AS id_r, round({km_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 3) AS km FROM spots a JOIN spots b ON {km_sql('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 5")
def within_5km_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    right = p.select(F.col("id").alias("id_r"), F.col("lat").alias("lat_r"), F.col("lng").alias("lng_r"))
    return pairs_within_km(p.select("id", "lat", "lng"), right, 5, digits=3).select("id", "id_r", "km")


BOXES = [("north", 36.5, 40.0, 126.0, 130.0), ("south", 33.0, 36.6, 126.0, 130.0), ("west", 33.0, 40.0, 126.0, 127.5)]


@query(f"WITH {PLACES_SQL}, boxes(box_region, s, n, w, e) AS (VALUES {', '.join(map(str, BOXES))}) SELECT id, box_region FROM spots JOIN boxes ON lat BETWEEN s AND n AND lng BETWEEN w AND e")
def bbox_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spark.createDataFrame(BOXES, "box_region string, south double, north double, west double, east double")
    return box_regions(places(spark, sf_dir), boxes).select("id", "box_region")


QUANTILES = {"median": 0.5, "p90": 0.9, "p95": 0.95}


@query(f"{LEGS_SQL}, v AS (SELECT round(km, 3) AS v FROM legs WHERE km IS NOT NULL), r AS (SELECT v, row_number() OVER (ORDER BY v) AS k, count(*) OVER () AS n FROM v) SELECT max(n) AS n, round(avg(v), 3) AS mean, {', '.join(f'max(v) FILTER (k = floor(n * {p}) + 1) AS {name}' for name, p in QUANTILES.items())}, max(v) AS max FROM r")
def hop_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.order_statistics(course.legs(steps(spark, sf_dir)), "km", QUANTILES)


@query(f"{LEGS_SQL} SELECT count(km) AS hops, {', '.join(f'count(*) FILTER (km > {x}) AS over_{x}' for x in (15, 30, 50, 100))} FROM legs")
def hop_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.beyond(course.legs(steps(spark, sf_dir)), [15, 30, 50, 100])


@query(f"""WITH {ELIGIBLE_SQL}, rows AS (SELECT id, slot, region, unnest(moods) AS mood FROM pool) SELECT CASE WHEN grouping(region) = 1 THEN 'ALL' ELSE region END AS region, CASE WHEN grouping(mood) = 1 THEN 'ALL' ELSE mood END AS mood, slot, count(DISTINCT id) AS n
FROM rows GROUP BY GROUPING SETS ((slot, region, mood), (slot, region), (slot, mood), (slot))""")
def candidate_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.candidate_cube(offered(spark, sf_dir))


@query(f"""{COURSE_SQL} SELECT dimension, member, count(*) AS steps, count(*) FILTER (id IS NULL) AS empty, round(1 - count(*) FILTER (id IS NULL)::DOUBLE / count(*), 6) AS filled
FROM (SELECT 'slot' AS dimension, slot AS member, id FROM steps UNION ALL SELECT 'wanted', wanted, id FROM steps UNION ALL SELECT 'ALL', 'ALL', id FROM steps) z GROUP BY ALL""")
def fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = requests(spark, sf_dir).select("request_id", "pos", "wanted")
    return audit.fill_rates(steps(spark, sf_dir).join(wanted, ["request_id", "pos"]), ["slot", "wanted"])


@query(f"""{FREE_SQL}, per AS (SELECT request_id, wanted, count(*) AS n, count(*) FILTER (region <> wanted) AS away, count(DISTINCT region) AS regions FROM steps WHERE region IS NOT NULL GROUP BY ALL)
SELECT wanted, sum(n)::BIGINT AS steps, sum(away)::BIGINT AS elsewhere, count(*) FILTER (regions > 1) AS mixed_courses FROM per GROUP BY wanted""")
def region_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = free_requests(spark, sf_dir).select("request_id", "pos", "wanted")
    return audit.contamination(free_steps(spark, sf_dir).join(wanted, ["request_id", "pos"]), "wanted", "region")


@query(f"{FREE_SQL} SELECT request_id, count(*) AS n, count(DISTINCT id) AS different FROM steps WHERE id IS NOT NULL GROUP BY request_id HAVING count(*) > count(DISTINCT id)")
def course_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicates(free_steps(spark, sf_dir))


@query(f"{COURSE_SQL} SELECT slot, tier, count(DISTINCT id) AS different FROM steps GROUP BY ALL")
def course_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.diversity(steps(spark, sf_dir), ["slot", "tier"])


@query(f"{COURSE_SQL} SELECT request_id, {', '.join(f"max(id) FILTER (slot = '{s}') AS {s}" for s in SLOTS)}, (sum(id) % 10)::BIGINT AS template FROM steps GROUP BY request_id")
def course_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pivot_slots(steps(spark, sf_dir), SLOTS)


@query(f"{COURSE_SQL} SELECT request_id, string_agg((pos + 1)::VARCHAR || '. ' || slot || ' ' || coalesce(id::VARCHAR, '-'), chr(10) ORDER BY pos) AS text FROM steps GROUP BY request_id")
def course_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course.as_text(steps(spark, sf_dir))


@query(f"{COURSE_SQL} SELECT request_id, string_agg(id::VARCHAR, '.' ORDER BY pos) AS link FROM steps WHERE id IS NOT NULL GROUP BY request_id")
def share_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course.encode_link(steps(spark, sf_dir))


@query(f"""{COURSE_SQL}, s AS (SELECT request_id, id, k.slot, name, pos FROM steps k JOIN (SELECT id, name FROM spots) p USING (id))
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY CASE slot WHEN 'day' THEN 1 WHEN 'evening' THEN 2 WHEN 'night' THEN 3 ELSE 4 END, pos) - 1 AS step, id, slot, name FROM s""")
def shared_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course.shared_steps(course.encode_link(steps(spark, sf_dir)), places(spark, sf_dir), SLOTS)


@query(f"WITH {PLACES_SQL} SELECT count(*) AS total, count(*) FILTER (balance < 0) AS closed, count(*) FILTER (NOT balance < 0) AS active, count(*) FILTER (lat IS NOT NULL) AS with_image FROM spots")
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.status_totals(places(spark, sf_dir), F.col("balance") < 0, F.col("lat").isNotNull())


@query(f"WITH {PLACES_SQL} SELECT slot AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM spots), 4) AS percent FROM spots GROUP BY slot")
def slot_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.distribution(places(spark, sf_dir), "slot")


@query(f"WITH {PLACES_SQL} SELECT tag, count(*) AS n FROM (SELECT unnest(moods) AS tag FROM spots) z GROUP BY tag")
def tag_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.tag_distribution(places(spark, sf_dir), "moods")


@query(f"WITH {PLACES_SQL} SELECT area, count(*) AS n FROM spots GROUP BY area ORDER BY n DESC, area LIMIT 20")
def top_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top_values(places(spark, sf_dir), "area")


@query(f"WITH {PLACES_SQL}, h AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS k FROM spots QUALIFY k < 1000), t AS (SELECT *, greatest(1, (count(*) OVER ()) // 100) AS step FROM h) SELECT id FROM t WHERE k % step = 0 AND k / step < 100")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.stride_sample(places(spark, sf_dir), "id").select("id")


@query(f"WITH {PLACES_SQL} SELECT id FROM spots ORDER BY md5(concat('7-', id)), id LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.seeded_sample(places(spark, sf_dir), "id", 50, 7).select("id")
