"""Queries about texts: predicates, normalisers, scores, mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import scoring, text
from waymark.operators import audit, mining, pools, repair, resolve
from waymark.plans.registry import query
from waymark.sources.tables import PLACES_SQL, places, table

SYNONYMS = {"metal": ["bolt", "gear", "ring"], "warm": ["red", "hot"]}


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red small') OR contains(lower(p_name), 'red') OR contains(lower(p_name), 'small')")
def keyword_search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).filter(text.matches_query(F.col("p_name"), F.lit("#Red, small"))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'small') AND contains(lower(p_name), 'ring')")
def keyword_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).filter(text.matches_query(F.col("p_name"), F.lit("Small/ring"), "all")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), 'bolt|gear|ring')")
def synonym_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).filter(text.matches_synonyms(F.col("p_name"), F.lit("any metal"), SYNONYMS)).select("p_partkey")


@query("SELECT p_partkey, contains(replace(replace(p_type, 'SMALL', ' '), 'STANDARD', ' '), 'A') AS hit FROM part")
def false_host_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", text.contains_masked(F.col("p_type"), "A", ["SMALL", "STANDARD"]).alias("hit"))


@query("""SELECT p_partkey, reason IS NULL AS ok, reason FROM (SELECT p_partkey, CASE WHEN p_name LIKE '%ring' THEN 'pattern' WHEN contains(p_type, 'PROMO') THEN 'blacklist' WHEN p_type = '' THEN 'no category'
WHEN p_brand = 'Brand#11' THEN 'chain' WHEN NOT regexp_matches(p_type, 'ECONOMY|SMALL|MEDIUM') THEN 'not listed' END AS reason FROM part) z""")
def category_gate_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_type")
    rules = [(F.endswith("p_name", F.lit("ring")), "pattern"), (F.contains(kind, F.lit("PROMO")), "blacklist"), (kind == "", "no category"), (F.col("p_brand") == "Brand#11", "chain"), (~text.contains_any(kind, ["ECONOMY", "SMALL", "MEDIUM"]), "not listed")]
    return parts(spark, sf_dir).withColumn("v", pools.first_reason(rules)).select("p_partkey", "v.ok", "v.reason")


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', p_name, p_brand, p_type)), '[^a-z0-9]+'), lambda x: x <> ''))), ' ') AS tokens FROM part")
def fts_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", F.array_join(mining.search_tokens(F.col("p_name"), F.col("p_brand"), F.col("p_type")), " ").alias("tokens"))


TRIGRAMS = "list_distinct([substring('  ' || lower({0}) || ' ', i, 3) for i in range(1, length({0}) + 2)])"


@query(f"""WITH p AS (SELECT name, count(*) AS n, {TRIGRAMS.format('name')} AS g FROM (SELECT p_name || ' ' || p_brand AS name FROM part) z GROUP BY name)
SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))), 4) AS sim, a.n AS n_a, b.n AS n_b
FROM p a JOIN p b ON a.name < b.name WHERE 10 * len(list_intersect(a.g, b.g)) >= 7 * len(list_distinct(list_concat(a.g, b.g)))""")
def trigram_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names (with brands) of a trigram similarity of 0.7 or more, and how many parts have each."""
    named = parts(spark, sf_dir).select(F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    sizes = named.groupBy("name").agg(F.count("*").alias("n"))
    size = lambda s: sizes.select(F.col("name").alias(s), F.col("n").alias(f"n_{s}"))
    pairs = resolve.similar_names(named, "name", 0.7)
    return pairs.join(size("a"), "a").join(size("b"), "b").select("a", "b", F.round("sim", 4).alias("sim"), "n_a", "n_b")


#: Counts as people write them, made of a part's size: thousands and more, with and without fractions, groups, words around them, none.
SAID = """CASE p_type WHEN 'ECONOMY' THEN '조회수 ' || p_size || '.' || p_size % 10 || '만회' WHEN 'SMALL' THEN p_size || 'K views' WHEN 'LARGE' THEN p_size || ',' || (100 + p_size) || ' ' WHEN 'MEDIUM' THEN p_size || '.5천' WHEN 'STANDARD' THEN p_size || '.25m' ELSE 'none' END"""


@query("""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN p_size * 10000 + p_size % 10 * 1000 WHEN 'SMALL' THEN p_size * 1000 WHEN 'LARGE' THEN p_size * 1000 + 100 + p_size WHEN 'MEDIUM' THEN p_size * 1000 + 500 WHEN 'STANDARD' THEN p_size * 1000000 + 250000 END::BIGINT AS n FROM part""")
def human_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", text.human_number(F.expr(SAID)).alias("n"))


@query("SELECT page_id, array_to_string(list_filter([trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) for x in regexp_extract_all(html, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1)], lambda x: x <> ''), '|') AS paragraphs, array_to_string(list_filter([trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) for x in regexp_extract_all(html, '(?s)<title(?:\\s[^>]*)?>(.*?)</title>', 1)], lambda x: x <> ''), '|') AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(mining.tag_texts(F.col("html"), "p"), "|").alias("paragraphs"), F.array_join(mining.tag_texts(F.col("html"), "title"), "|").alias("title"))


@query("""SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct([trim(x) for x in list_concat(regexp_extract_all(coalesce(text, ''), '"([^"\\n]+)"', 1), regexp_extract_all(coalesce(text, ''), '(?m)^[-*] ([^\\n]+)', 1), regexp_extract_all(coalesce(text, ''), '\\(([a-z]+)\\)', 1))]), lambda x: length(x) BETWEEN 2 AND 12 AND NOT contains(x, 'zz'))), '|') AS items FROM documents""")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.quoted_items(F.col("text"), ['"([^"\\n]+)"', "(?m)^[-*] ([^\\n]+)", "\\(([a-z]+)\\)"], stop=["zz"])
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.array_join(F.array_sort(found), "|"), F.lit("")).alias("items"))


@query("SELECT event_id, nullif(regexp_extract(props, '(?s)\\{.*\\}', 0), '') AS json, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = text.salvage_json(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    return table(spark, sf_dir, "events").select("event_id", json.alias("json"), F.get_json_object(json, "$.k").cast("long").alias("k"))


@query("SELECT CASE WHEN h BETWEEN 5 AND 13 THEN 'day,evening' WHEN h BETWEEN 14 AND 19 THEN 'evening,night' ELSE 'night,stay' END AS slots, count(*) AS n FROM (SELECT hour(ts) AS h FROM events) z GROUP BY slots")
def time_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.array_join(text.time_slots(F.hour("ts")), ",").alias("slots")).agg(F.count("*").alias("n"))


@query(f"WITH {PLACES_SQL} SELECT id, least(100, 40 + CASE WHEN length(trim(name)) > 10 THEN 15 ELSE 0 END + CASE WHEN len(moods) > 1 THEN 10 ELSE 0 END + CASE WHEN balance > 0 THEN 15 ELSE 0 END + CASE WHEN lat IS NOT NULL THEN 10 ELSE 0 END + 5 + 5) AS score FROM spots")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = scoring.quality_score(F.col("name"), F.size("moods") > 1, F.col("balance") > 0, F.col("lat").isNotNull(), F.col("category"), F.col("area"))
    return places(spark, sf_dir).select("id", score.alias("score"))


METRICS_SQL = "m AS (SELECT user_id, count(*) * 1000 AS views, CASE WHEN user_id % 3 <> 0 THEN round(3 + (trunc(sum(value * 100))::BIGINT % 200) / 1e2, 2) END AS rating, user_id % 2 = 0 AS short, user_id % 5 = 0 AS verified FROM (SELECT user_id, round(value, 2) AS value FROM events) z GROUP BY user_id)"
BANDS_SQL = "v AS (SELECT *, CASE WHEN views >= 100000 THEN 40 WHEN views >= 50000 THEN 35 WHEN views >= 10000 THEN 28 WHEN views >= 3000 THEN 20 ELSE 15 END AS clip, CASE WHEN rating IS NULL THEN 25 WHEN rating >= 4.5 THEN 35 WHEN rating >= 4.0 THEN 30 WHEN rating >= 3.5 THEN 25 ELSE 20 END AS rated, CASE WHEN verified THEN 20 ELSE 10 END AS bonus FROM m)"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, views, rating, short, verified from events."""
    cents = F.sum(F.round("value", 2) * 100).cast("long")
    found = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") * 1000).alias("views"), cents.alias("cents"))
    rating = F.when(F.col("user_id") % 3 != 0, F.round(3 + (F.col("cents") % 200) / 100, 2))
    return found.select("user_id", "views", rating.alias("rating"), (F.col("user_id") % 2 == 0).alias("short"), (F.col("user_id") % 5 == 0).alias("verified"))




@query(f"WITH {METRICS_SQL}, {BANDS_SQL} SELECT user_id, least(100, least(45, clip + CASE WHEN short THEN 5 ELSE 0 END) + rated + bonus)::DOUBLE AS hot, (2.5 * rated + bonus)::DOUBLE AS trust FROM v")
def hot_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = scoring.hot_score(F.col("views"), F.col("short"), F.col("rating"), F.col("verified"))
    return metrics(spark, sf_dir).withColumn("s", score).select("user_id", "s.hot", "s.trust")


@query(f"WITH {METRICS_SQL}, {BANDS_SQL} SELECT user_id FROM v WHERE views >= 50000 OR least(100, least(45, clip + CASE WHEN short THEN 5 ELSE 0 END) + rated + bonus) >= 80 OR (user_id % 10 <= 7 AND verified) OR rating >= 4.6")
def super_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir)
    hot = scoring.hot_score(F.col("views"), F.col("short"), F.col("rating"), F.col("verified"))["hot"]
    return m.filter(scoring.super_hot(F.col("views") >= 10_000, F.col("views"), hot, F.col("user_id") % 10, F.col("verified"), F.col("rating"))).select("user_id")


@query("SELECT p_partkey, p_name IS NULL OR length(trim(p_name)) < 5 OR lower(trim(p_name)) = lower(trim(p_type)) OR regexp_matches(trim(p_name), '^[a-z]+(,\\s*[a-z]+)*$') OR (contains(lower(trim(p_name)), 'red') AND length(trim(p_name)) < 30) AS bad FROM part")
def bad_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", scoring.bad_summary(F.col("p_name"), F.col("p_type"), ["red"]).alias("bad"))


GATE_SQL = """g AS (SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) < 100 THEN 'short' WHEN contains(text, '#') THEN 'symbols' WHEN lang IS NULL OR lang NOT IN (SELECT min(lang) FROM documents) THEN 'language' ELSE 'kept' END AS outcome FROM documents)"""


@query(f"WITH {GATE_SQL} SELECT outcome, count(*) AS n FROM g GROUP BY outcome")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.join(F.broadcast(docs.agg(F.min("lang").alias("first"))))
    stages = [("empty", F.trim("text") != ""), ("short", F.length("text") >= 100), ("symbols", ~F.contains("text", F.lit("#"))), ("language", F.col("lang") == F.col("first"))]
    return audit.funnel(docs, stages)[1]


@query(f"WITH {GATE_SQL} SELECT quality, outcome <> 'short' AND outcome <> 'empty' AND outcome <> 'symbols' AS passed, count(*) AS n FROM g JOIN labels USING (doc_id) GROUP BY ALL")
def gate_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = [("empty", F.trim("text") != ""), ("short", F.length("text") >= 100), ("symbols", ~F.contains("text", F.lit("#")))]
    marked, _ = audit.funnel(table(spark, sf_dir, "documents").select("doc_id", "text"), stages)
    return marked.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", (F.col("outcome") == "kept").alias("passed")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_size, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY contains(p_type, 'SMALL'), p_retailprice, p_partkey) AS k FROM part) z WHERE k = 1""")
def best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = parts(spark, sf_dir).select("p_size", F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("rank"), "p_name", "p_type")
    return resolve.best_hit(hits, ["p_size"], F.contains("p_type", F.lit("SMALL"))).select(F.col("id").alias("p_partkey"), "p_size", "p_name")


HITS_SQL = "hits AS (SELECT p_partkey AS id, p_size AS query, p_partkey % 2 AS attempt, p_partkey % 3 AS provider, p_retailprice AS rank FROM part)"


@query(f"WITH {HITS_SQL}, f AS (SELECT query, min(attempt * 10 + provider) AS first FROM hits GROUP BY query) SELECT query, id FROM hits JOIN f USING (query) WHERE attempt * 10 + provider = first QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank, id) <= 6")
def fallback_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    hits = parts(spark, sf_dir).select(key.alias("id"), F.col("p_size").alias("query"), (key % 2).alias("attempt"), (key % 3).alias("provider"), F.col("p_retailprice").alias("rank"))
    return resolve.fallback_hits(hits, "query", 6).select("query", "id")


@query("SELECT p_size AS query, p_partkey AS id, contains(p_type, 'PROMO') OR contains(p_type, 'LARGE') AS located FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY NOT (contains(p_type, 'PROMO') OR contains(p_type, 'LARGE')), p_retailprice, p_partkey) = 1")
def preferred_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = parts(spark, sf_dir).select(F.col("p_size").alias("query"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("rank"), "p_type", F.array(F.lit("PROMO"), F.lit("LARGE")).alias("hints"))
    return resolve.preferred_hit(hits, "query", "p_type", "hints").select("query", "id", "located")


@query("SELECT md5(text) AS name, min(doc_id) AS id FROM documents d WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents k WHERE k.doc_id % 7 = 0 AND k.text = d.text) GROUP BY text")
def dedup_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.md5("text").alias("name"), F.col("doc_id").alias("id"))
    return resolve.unknown(docs, docs.filter("id % 7 = 0"), "name")


@query("SELECT p_type, min(p_partkey) AS pos FROM part GROUP BY p_type ORDER BY pos, p_type LIMIT 12")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.keep_first(parts(spark, sf_dir).withColumn("pos", F.col("p_partkey")), "p_type", "pos", 12)


@query("SELECT p_size, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice, p_partkey) <= 4 ORDER BY p_size, p_retailprice, p_partkey LIMIT 100")
def per_key_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.cap_per_key(parts(spark, sf_dir), "p_size", ["p_retailprice", "p_partkey"], 4, 100).select("p_size", "p_partkey")


@query()
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one size and brand whose names match; the ratio has no SQL form."""
    p = parts(spark, sf_dir)
    name = F.concat_ws(" ", F.concat(F.lit("b"), F.substring("p_brand", 7, 2), F.lit("s"), F.col("p_size")), "p_name")
    left = p.select("p_brand", "p_size", F.col("p_partkey").alias("id"), name.alias("name"))
    right = p.select("p_brand", "p_size", F.col("p_partkey").alias("id_r"), name.alias("name_r"))
    return resolve.name_pairs(left, right, ["part"], on=["p_brand", "p_size"], ascending=True)


PROVINCES = [(["서울"], "SEOUL", True), (["부산"], "BUSAN", True), (["경기"], "GYEONGGI", False)]
#: Addresses made of a place's region, area, category and balance, in SQL that both engines run.
ADDRESS = """CASE WHEN balance < -500 THEN NULL WHEN balance < 0 THEN ' ' ELSE CASE region WHEN 'AFRICA' THEN '서울특별시' WHEN 'AMERICA' THEN '부산' WHEN 'ASIA' THEN '경기도' WHEN 'EUROPE' THEN 'somewhere' ELSE '경기' END
  || '  ' || CASE category WHEN 'BUILDING' THEN area || '구 12' WHEN 'AUTOMOBILE' THEN area || '시' WHEN 'MACHINERY' THEN '3 ' || area || '군' WHEN 'FURNITURE' THEN area ELSE '분당구 ' || area || '시' END END"""
BY_LAT = "CASE WHEN lat IS NULL THEN NULL WHEN lat < 35 THEN 'BUSAN' WHEN lat < 37 THEN 'SEOUL' ELSE 'GYEONGGI' END"
#: What the parser should say, from the columns themselves.
PARSED_SQL = f"""{PLACES_SQL}, said AS (SELECT *, CASE region WHEN 'AFRICA' THEN 'SEOUL' WHEN 'AMERICA' THEN 'BUSAN' WHEN 'EUROPE' THEN NULL ELSE 'GYEONGGI' END AS own, region IN ('AFRICA', 'AMERICA') AS metro FROM spots),
  found AS (SELECT *, CASE WHEN balance >= 0 THEN own END AS to_region, CASE WHEN balance < 0 OR own IS NULL THEN NULL WHEN category = 'MACHINERY' THEN area || '군' WHEN metro AND category = 'BUILDING' THEN area || '구' WHEN metro AND category = 'HOUSEHOLD' THEN '분당구' WHEN NOT metro AND category IN ('AUTOMOBILE', 'HOUSEHOLD') THEN area || '시' END AS to_area FROM said),
  parsed AS (SELECT *, CASE WHEN balance < 0 THEN 'no_address' WHEN own IS NULL THEN 'unparseable' WHEN to_area IS NULL THEN 'no_area' ELSE 'ok' END AS status, {BY_LAT} AS by_lat FROM found),
  stored AS (SELECT *, CASE WHEN category = 'MACHINERY' THEN by_lat ELSE coalesce(own, 'SEOUL') END AS old_region, CASE WHEN balance > 3000 THEN to_area ELSE area END AS old_area, lat IS NULL OR by_lat = to_region AS box_ok FROM parsed)"""


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places with what their addresses say (status, to_region, to_area) and where their latitude lies."""
    found = places(spark, sf_dir).withColumn("x", repair.parse_address(F.expr(ADDRESS), PROVINCES)).withColumn("by_lat", F.expr(BY_LAT))
    return found.select("*", "x.status", F.col("x.region").alias("to_region"), F.col("x.area").alias("to_area")).drop("x")


@query(f"WITH {PARSED_SQL} SELECT id, status, to_region, to_area FROM parsed")
def address_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("id", "status", "to_region", "to_area")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parsed() with the stored region and area, and whether the coordinates agree with the address."""
    mapped = F.when(F.col("region") == "AFRICA", "SEOUL").when(F.col("region") == "AMERICA", "BUSAN").when(F.col("region") == "EUROPE", "SEOUL").otherwise("GYEONGGI")
    old_region = F.when(F.col("category") == "MACHINERY", F.col("by_lat")).otherwise(mapped)
    old_area = F.when(F.col("balance") > 3000, F.col("to_area")).otherwise(F.col("area"))
    box_ok = F.col("lat").isNull() | (F.col("by_lat") == F.col("to_region"))
    return parsed(spark, sf_dir).select("id", "status", "to_region", "to_area", old_region.alias("old_region"), old_area.alias("old_area"), box_ok.alias("box_ok"))


@query(f"WITH {PARSED_SQL} SELECT CASE WHEN status <> 'ok' THEN status WHEN old_region = to_region AND old_area = to_area THEN 'match' WHEN NOT box_ok THEN 'conflict' ELSE 'fixable' END AS class, count(*) AS n FROM stored GROUP BY class")
def repair_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = repair.repair_class(*map(F.col, ("status", "old_region", "old_area", "to_region", "to_area", "box_ok")))
    return stored(spark, sf_dir).groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {PARSED_SQL} SELECT old_region AS old, to_region AS \"new\", count(*) AS n FROM stored WHERE status = 'ok' AND old_region IS DISTINCT FROM to_region GROUP BY ALL")
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.transitions(stored(spark, sf_dir).filter("status = 'ok'"), "old_region", "to_region")
