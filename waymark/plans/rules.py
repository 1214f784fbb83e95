"""Queries about classes, gates, cleaners and labels, over the columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import classify, gates, labels, scoring, text
from waymark.operators import mining, pools, zones
from waymark.plans.registry import query
from waymark.sources.tables import PLACES_SQL, places, table


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


@query("""SELECT p_partkey, CASE WHEN contains(p_type, 'PROMO') THEN NULL WHEN contains(p_type, 'ECONOMY') THEN CASE WHEN NOT contains(p_name, 'ring') THEN 'stay' END
WHEN contains(p_name, 'gear') AND NOT contains(p_name, 'ring') THEN NULL WHEN contains(p_type, 'LARGE') THEN 'night' WHEN contains(p_type, 'MEDIUM') THEN 'evening' WHEN p_type = 'STANDARD' THEN 'day' END AS slot FROM part""")
def slot_of_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = classify.slot_of_category(F.col("p_type"), F.col("p_name"), ["PROMO"], ["ECONOMY"], ["ring"], [("night", ["LARGE"]), ("evening", ["MEDIUM"])], {"STANDARD": "day"}, ["gear"], r"[>,/·|]")
    return parts(spark, sf_dir).select("p_partkey", slot.alias("slot"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'bolt|blue') THEN 'night' WHEN regexp_matches(p_name, 'gear|hot') THEN 'evening' ELSE 'day' END AS slot FROM part")
def slot_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return parts(spark, sf_dir).select("p_partkey", classify.first_class([(classify.any_pattern(name, ["bolt", "blue"]), "night"), (classify.any_pattern(name, ["gear", "hot"]), "evening")], "day").alias("slot"))


MOODS = [("warm", ["red", "hot"]), ("cool", ["blue", "cold"]), ("round", ["ring", "gear"]), ("little", ["small"])]
FOUND_SQL = "list_filter([CASE WHEN regexp_matches({t}, 'red|hot') THEN 'warm' END, CASE WHEN regexp_matches({t}, 'blue|cold') THEN 'cool' END, CASE WHEN regexp_matches({t}, 'ring|gear') THEN 'round' END, CASE WHEN contains({t}, 'small') THEN 'little' END], lambda m: m IS NOT NULL)"


@query(f"""WITH f AS (SELECT *, {FOUND_SQL.format(t="p_name")} AS m FROM part) SELECT p_partkey, CASE WHEN contains(p_type, 'ECONOMY') THEN 'stay' WHEN contains(p_name, 'bolt') THEN 'night' ELSE 'day' END AS slot,
array_to_string(CASE WHEN len(m) > 0 THEN m[1:2] ELSE ['plain', 'calm'] END, ',') AS moods FROM f""")
def slot_and_moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.slot_and_moods(F.col("p_type"), F.col("p_name"), ["ECONOMY"], [("night", ["bolt"])], MOODS, ["plain", "calm"], 2)
    return parts(spark, sf_dir).withColumn("x", found).select("p_partkey", "x.slot", F.array_join("x.moods", ",").alias("moods"))


@query("""SELECT doc_id, CASE WHEN contains(source, '7') THEN 'stay' WHEN regexp_matches(coalesce(text, ''), ' of the ') THEN 'night' WHEN regexp_matches(coalesce(text, ''), ' und | et ') THEN 'evening' ELSE 'day' END AS slot FROM documents""")
def slot_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("text")
    rules = [(classify.any_pattern(F.col("source"), ["7"]), "stay"), (classify.any_pattern(body, [" of the "]), "night"), (classify.any_pattern(body, [" und ", " et "]), "evening")]
    return table(spark, sf_dir, "documents").select("doc_id", classify.first_class(rules, "day").alias("slot"))


@query(f"SELECT p_partkey, array_to_string(list_filter(['warm', 'cool', 'round', 'little', 'big'], lambda m: list_contains(list_concat(CASE p_type WHEN 'LARGE' THEN ['big'] WHEN 'SMALL' THEN ['little'] ELSE [] END, {FOUND_SQL.format(t='p_name')}), m)), ',') AS moods FROM part")
def moods_of_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.moods_of(F.array("p_type"), F.col("p_name"), {"LARGE": "big", "SMALL": "little"}, MOODS)
    order = F.array(*map(F.lit, ["warm", "cool", "round", "little", "big"]))
    return parts(spark, sf_dir).select("p_partkey", F.array_join(F.array_intersect(order, found), ",").alias("moods"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(url), 'example\\.org|\\.net') THEN 'site' ELSE 'web' END AS kind, (starts_with(trim(url), 'http://') OR starts_with(trim(url), 'https://')) AND length(trim(url)) >= 40 AS valid, contains(url, '/fr/') OR contains(lower(html), 'a href=\"/the\"') AS short FROM pages")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", classify.source_kind(url, ["example.org", ".net"], "site").alias("kind"), gates.valid_url(url, 40).alias("valid"), gates.short_form(url, F.col("html"), "/fr/", ['a href="/the"']).alias("short"))


KINDS = [("MACHINERY", "works", "loud", "day"), ("BUILDING", "house", "quiet", "stay"), ("AUTOMOBILE", "garage", "loud", "evening")]


@query(f"WITH kinds(segment, label, mood, slot) AS (VALUES {', '.join(map(str, KINDS))}) SELECT c_custkey AS id, coalesce(label, 'other') AS label, coalesce(mood, 'calm') AS mood, coalesce(slot, 'day') AS slot FROM customer LEFT JOIN kinds ON c_mktsegment = segment")
def defaults_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame(KINDS, "c_mktsegment string, label string, mood string, slot string")
    joined = table(spark, sf_dir, "customer").join(F.broadcast(kinds), "c_mktsegment", "left")  # a fixed list
    return joined.select(F.col("c_custkey").alias("id"), *(F.coalesce(c, F.lit(d)).alias(c) for c, d in (("label", "other"), ("mood", "calm"), ("slot", "day"))))


@query("SELECT p_partkey, regexp_matches(p_name, 'small|large|red') AND list_has_any(string_split(p_name, ' '), ['ring', 'bolt']) AS conflict FROM part")
def facility_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", gates.facility_conflict(F.col("p_name"), ["small", "large", "red"], ["ring", "bolt"]).alias("conflict"))


PRICE_SQL = "lower(p_type || ' ' || p_size || ' ' || p_name)"


@query(f"SELECT p_partkey, CASE WHEN regexp_matches({PRICE_SQL}, 'promo|bolt') THEN regexp_matches({PRICE_SQL}, '[0-5] *(red|small)') ELSE regexp_matches({PRICE_SQL}, '[0-5] *(red|small)') OR (contains({PRICE_SQL}, 'economy') AND contains({PRICE_SQL}, 'ring')) END AS lodging FROM part")
def lodging_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.concat_ws(" ", "p_type", "p_size", "p_name")
    return parts(spark, sf_dir).select("p_partkey", gates.lodging_price(price, "[0-5] *(red|small)", "promo|bolt", ["economy", "ring"]).alias("lodging"))


@query("SELECT p_partkey, length(p_name) > 10 OR contains(p_name, 'gear') AS header, regexp_matches(p_name, 'widget|hot') OR starts_with(p_name, 'small') OR regexp_matches(p_name, '^red.*t$') AS dummy FROM part")
def name_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return parts(spark, sf_dir).select("p_partkey", gates.header_like(name, ["gear"], 10).alias("header"), gates.dummy_name(name, ["widget"], ["hot"], ["^red.*t$"], ["small"]).alias("dummy"))


@query("""WITH d AS (SELECT doc_id, lower(coalesce(string_split(text, chr(10))[1], '') || ' ' || substring(coalesce(text, ''), 1, 300)) AS blob, coalesce(string_split(text, chr(10))[1], '') AS title FROM documents)
SELECT doc_id, CASE WHEN contains(blob, 'erschaft') THEN 'erschaft' WHEN contains(blob, 'ción') THEN 'ción' WHEN regexp_matches(title, '[êçèÊÇÈ]') THEN 'script' ELSE '' END AS reason FROM d""")
def foreign_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.coalesce(F.get(F.split("text", "\n"), F.lit(0)), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", gates.foreign_content(title, F.col("text"), ["erschaft", "ción"], "[êçèÊÇÈ]", "script").alias("reason"))


@query("SELECT p_partkey, trim(regexp_replace(replace(replace(p_name, 'small', ' '), 'red', ' '), '\\s+', ' ', 'g')) AS simple, CASE WHEN length(trim(regexp_replace(p_name, '\\s+(?:ring|bolt).*$', ''))) >= 4 THEN trim(regexp_replace(p_name, '\\s+(?:ring|bolt).*$', '')) ELSE p_name END AS clean, replace(replace(p_name, 'ring', 'Ring'), 'hot', 'warm') AS renamed FROM part")
def cleaned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return parts(spark, sf_dir).select("p_partkey", gates.without_words(name, ["small", "red"]).alias("simple"), gates.clean_name(name, ["ring", "bolt"], 4).alias("clean"), labels.renamed(name, {"ring": "Ring", "hot": "warm"}).alias("renamed"))


@query("SELECT doc_id, trim(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[#*%!]', ' ', 'g'), '\\s+', ' ', 'g')), ' .,-·:;|/') AS candidate FROM documents")
def clean_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", gates.clean_candidate(F.col("text"), "[#*%!]", " .,-·:;|/").alias("candidate"))


@query("SELECT event_id, CASE WHEN value < 20 OR contains(event_type, 'err') THEN 'post' ELSE 'clip,post' END AS kept FROM events")
def fresh_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.create_map(F.lit("clip"), F.col("props"), F.lit("post"), F.col("event_type"))
    kept = gates.fresh_links(links, F.col("value"), F.col("event_type"), 20, ["err"], "clip")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"))


@query(f"""WITH {PLACES_SQL} SELECT id, NOT (balance < 0 OR lat IS NULL OR length(name) > 40) AS ok,
array_to_string(list_filter([CASE WHEN balance < 0 THEN 'balance' END, CASE WHEN lat IS NULL THEN 'point' END, CASE WHEN length(name) > 40 THEN 'name' END], lambda x: x IS NOT NULL), '; ') AS error FROM spots""")
def checked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(F.col("balance") < 0, "balance"), (F.col("lat").isNull(), "point"), (F.length("name") > 40, "name")]
    return places(spark, sf_dir).withColumn("v", gates.checked(rules)).select("id", "v.ok", "v.error")


@query(f"""WITH {PLACES_SQL}, d AS (SELECT *, CASE WHEN category = 'BUILDING' THEN 'stay' WHEN category = 'MACHINERY' THEN 'night' END AS derived FROM spots)
SELECT id, CASE WHEN derived IS NOT NULL AND slot <> derived AND (balance > 5000 OR slot = 'stay' OR derived = 'stay') THEN derived END AS healed FROM d""")
def healed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = F.when(F.col("category") == "BUILDING", "stay").when(F.col("category") == "MACHINERY", "night")
    return places(spark, sf_dir).select("id", classify.heal_slot(F.col("slot"), derived, F.col("balance") > 5000).alias("healed"))


@query(f"""WITH {PLACES_SQL} SELECT id, array_to_string(list_filter([CASE x WHEN 'quiet' THEN 'Quiet' WHEN 'lively' THEN 'Lively' WHEN 'building' THEN 'House' END for x in moods], lambda x: x IS NOT NULL)[1:2], ', ') AS shown,
CASE len(moods) WHEN 1 THEN moods[1] WHEN 2 THEN 'all' ELSE 'all' END AS chosen, abs(id) % 7 AS image FROM spots""")
def mood_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = labels.known_labels(F.col("moods"), {"quiet": "Quiet", "lively": "Lively", "building": "House"}, 2)
    return places(spark, sf_dir).select("id", F.array_join(shown, ", ").alias("shown"), labels.selection_label(F.col("moods"), 2, "all").alias("chosen"), labels.pool_index(F.col("id"), F.col("name"), 7).alias("image"))


@query("""WITH s AS (SELECT n_regionkey AS region, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey)
SELECT region, CASE WHEN len(names) = 25 THEN 'all' WHEN len(names) = 1 THEN names[1] WHEN len(names) = 2 THEN array_to_string(names, ', ') ELSE names[1] || ' + ' || (len(names) - 1) || ' more' END AS label, array_to_string(names, '·') AS joined FROM s""")
def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return names.select("region", labels.selection_label(F.col("names"), 25, "all").alias("label"), F.array_join("names", "·").alias("joined"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'widget') THEN 'widget' WHEN contains(p_name, 'small') THEN 'small' WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'red') THEN 'red' END AS key, array_to_string(string_split(p_name, ' ')[1:1], ' ') AS head FROM part")
def longest_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", labels.longest_key(F.col("p_name"), ["red", "ring", "small", "widget"]).alias("key"), F.array_join(F.slice(F.split("p_name", " "), 1, 1), " ").alias("head"))


@query("SELECT n_nationkey, CASE WHEN starts_with(n_name, 'NATION_1') THEN 'one' WHEN starts_with(n_name, 'NATION') THEN 'any' WHEN starts_with(n_name, 'U') THEN 'u' END AS value, CASE WHEN starts_with(n_name, 'NATION_1') THEN 'NATION_1' WHEN starts_with(n_name, 'NATION') THEN 'NATION' WHEN starts_with(n_name, 'U') THEN 'U' END AS token FROM nation")
def prefix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = labels.prefix_rule(F.col("n_name"), [("NATION_1", "one"), ("NATION", "any"), ("U", "u")])
    return table(spark, sf_dir, "nation").withColumn("x", rule).select("n_nationkey", "x.value", "x.token")


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN '' ELSE p_type END AS chosen FROM part")
def saved_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices that were saved as a JSON string or as an array, by the part's size."""
    kind = F.when(F.col("p_type") == "PROMO", "ALL").otherwise(F.col("p_type"))
    json = F.when(F.col("p_size") > 20, F.concat(F.lit('"'), kind, F.lit('"'))).otherwise(F.concat(F.lit('["ALL","'), kind, F.lit('"]')))
    return parts(spark, sf_dir).select("p_partkey", F.array_join(labels.listed(json), ",").alias("chosen"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'Known for its ring: ' || p_name ELSE p_name || ' (' || p_brand || ')' END AS summary, CASE WHEN contains(p_name, 'bolt') THEN 'bolt' WHEN contains(p_name, 'gear') THEN 'wheel' ELSE 'box' END AS icon FROM part")
def summary_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    signature = F.when(F.contains(name, F.lit("ring")), "ring").otherwise("")
    icon = classify.first_class([(F.contains(name, F.lit("bolt")), "bolt"), (F.contains(name, F.lit("gear")), "wheel")], "box")
    return parts(spark, sf_dir).select("p_partkey", labels.template(signature, "Known for its {0}: {name}", "{name} ({brand})", name=name, brand=F.col("p_brand")).alias("summary"), icon.alias("icon"))


@query("SELECT conv_id, turn, md5(text) AS text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY role = 'assistant' DESC, turn, md5(text)) = 1")
def pinned_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.struct((F.col("role") != "assistant").alias("later"), "turn", F.md5("text").alias("text"))).alias("x")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(first).select("conv_id", "x.turn", "x.text")


@query("WITH h AS (SELECT p_size, CASE WHEN contains(p_name, 'red') THEN 1 WHEN contains(p_name, 'ring') THEN 2 WHEN contains(p_name, 'bolt') THEN 3 END AS priority, p_partkey FROM part) SELECT p_size, priority, p_partkey FROM h WHERE priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY priority, p_partkey) = 1")
def first_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    priority = F.when(F.contains(name, F.lit("red")), 1).when(F.contains(name, F.lit("ring")), 2).when(F.contains(name, F.lit("bolt")), 3)
    hits = parts(spark, sf_dir).withColumn("priority", priority).filter("priority is not null")
    return hits.groupBy("p_size").agg(F.min(F.struct("priority", "p_partkey")).alias("x")).select("p_size", "x.*")


@query("SELECT event_id, count(*) OVER w AS n, min(event_id) OVER w AS oldest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)")
def avoid_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user's step avoids: the 15 before it; here how many they are, and the smallest."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-15, -1)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(before).alias("n"), F.min("event_id").over(before).alias("oldest"))


@query(f"WITH {PLACES_SQL} SELECT id, list_contains(list_distinct(list_concat(moods, [slot])), 'quiet') AS hinted, len(list_distinct(list_concat(moods, [slot]))) AS hints FROM spots")
def hint_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = F.array_union("moods", F.array("slot"))
    return places(spark, sf_dir).select("id", pools.has_mood(hints, "quiet").alias("hinted"), F.size(hints).cast("long").alias("hints"))


ZONES = [
    ("one", ["Brand#1", "Brand#2", "Brand#3"], ["ring", "bolt", "강남"], {"ring": ["ring탕", "ring호"]}),
    ("two", ["Brand#4", "Brand#5", "Brand#6"], ["gear", "widget시", "red"], None),
    ("three", [], ["small", "gizmo동", "ring"], {"small": ["small호"]}),
]
ASIDES = ["근교", "인근", "출발", "IC"]
#: Parts as places: their areas and locations have units, asides and homographs.
SPOTS_SQL = """SELECT p_partkey AS id, p_name AS name, CASE WHEN p_retailprice % 7 < 6 THEN p_brand END AS region,
  CASE WHEN p_size <= 8 THEN split_part(p_name, ' ', 2) || '시' WHEN p_size <= 16 THEN split_part(p_name, ' ', 2) || '구' WHEN p_size <= 22 THEN ' ' || split_part(p_name, ' ', 2) || '동 ' WHEN p_size <= 30 THEN split_part(p_name, ' ', 2) WHEN p_size <= 36 THEN ' ' END AS area,
  CASE p_type WHEN 'ECONOMY' THEN split_part(p_name, ' ', 1) || ' 근교 ' || split_part(p_name, ' ', 2) || '출발' WHEN 'SMALL' THEN 'ring탕 ' || split_part(p_name, ' ', 1) || '호' WHEN 'LARGE' THEN '서울 강남구 ring탕 ring길' WHEN 'MEDIUM' THEN 'red IC gizmo동' END AS location FROM part"""


@query(f"""WITH spots AS ({SPOTS_SQL}), zones(zone, regions, words, compounds) AS (VALUES {', '.join(f"('{z}', {r}::VARCHAR[], {w}, {'NULL' if c is None else 'MAP ' + str(c)}::MAP(VARCHAR, VARCHAR[]))" for z, r, w, c in ZONES)}),
  known AS (SELECT list_distinct(flatten(list(regions))) AS all_regions FROM zones),
  placed AS (SELECT id, region, coalesce(nullif(trim(area), ''), nullif(regexp_extract(location, '([가-힣]+(?:구|시|군))', 1), '')) AS area, concat_ws(' ', name, coalesce(location, '')) AS text FROM spots),
  met AS (SELECT p.*, z.*, unnest(words) AS word FROM placed p, zones z, known WHERE len(regions) = 0 OR region IS NULL OR NOT list_contains(all_regions, region) OR list_contains(regions, region)),
  told AS (SELECT *, regexp_replace(text, word || '\\s*(?:{"|".join(ASIDES)})', '', 'g') AS rest, ends_with(area, '시') OR ends_with(area, '군') AS city FROM met),
  judged AS (SELECT id, zone, area IN (word, word || '시', word || '군', word || '구', word || '광역시', word || '특별시', word || '특별자치시')
      OR right(word, 1) NOT IN ('구', '시', '군', '동', '읍', '면') AND len(area) = len(word) + 1 AND starts_with(area, word) AND right(area, 1) IN ('구', '시', '군', '동', '읍', '면') AS by_area,
    contains(rest, word) AND (len(list_filter(coalesce(compounds[word], []), lambda c: contains(rest, c))) = 0 OR regexp_matches(rest, word || '(?:광역시|\\s|[시구동길로]|$)'))
      AND (area IS NULL OR NOT city OR len(list_filter(words, lambda w: w = area OR starts_with(w, left(area, len(area) - 1)))) > 0) AS by_text FROM told)
SELECT DISTINCT id, zone FROM judged WHERE by_area OR by_text""")
def zone_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame(ZONES, "zone string, regions array<string>, words array<string>, compounds map<string,array<string>>")
    spots = spark.sql(SPOTS_SQL.removesuffix("FROM part") + "FROM {part}", part=table(spark, sf_dir, "part"))
    return zones.in_zones(spots, dim, ASIDES).select("id", "zone")


@query("SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['bolt', 'red']) AS token, array_to_string(list_filter([trim(regexp_replace(x, 'hot|small', '', 'g')) for x in string_split(p_name, ' ')], lambda x: x <> ''), '|') AS parts, replace(p_name, ' ', '&amp;') AS escaped FROM part")
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return parts(spark, sf_dir).select("p_partkey", text.has_token(name, ["bolt", "red"]).alias("token"), F.array_join(mining.title_parts(F.replace(name, F.lit(" "), F.lit("|")), ["hot", "small"]), "|").alias("parts"), text.escape_html(F.replace(name, F.lit(" "), F.lit("&"))).alias("escaped"))


@query("SELECT event_id, length(props) > 0 AND (value * 1000 >= 10000 OR user_id >= 500) AND NOT contains(event_type, 'err') AS valid FROM events")
def valid_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = scoring.valid_clip(F.col("props"), F.col("event_type"), F.col("value") * 1000, F.col("user_id"), ["err"], [])
    return table(spark, sf_dir, "events").select("event_id", ok.alias("valid"))


@query("""WITH g AS (SELECT p_size, p_partkey, p_partkey % 3 AS priority, length(p_name) > 8 AS passes FROM part), f AS (SELECT p_size, min(priority) AS priority FROM g WHERE passes GROUP BY p_size)
SELECT g.p_size, g.priority, g.p_partkey FROM g JOIN f ON g.p_size = f.p_size AND g.priority = f.priority WHERE passes""")
def source_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parts(spark, sf_dir).select("p_size", "p_partkey", (F.col("p_partkey") % 3).alias("priority"), (F.length("p_name") > 8).alias("passes"))
    return mining.first_source(found, ["p_size"]).select("p_size", "priority", "p_partkey")


@query("SELECT old, new, id, row_number() OVER (PARTITION BY old ORDER BY new, id::VARCHAR) AS rank FROM (SELECT o_orderstatus AS old, o_orderpriority AS new, o_orderkey AS id FROM orders) z")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("old"), F.col("o_orderpriority").alias("new"), F.col("o_orderkey").alias("id"))
    return o.withColumn("rank", F.row_number().over(Window.partitionBy("old").orderBy("new", F.col("id").cast("string"))))
