"""Queries about what places gain from other tables, and about saved courses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import labels, nested
from waymark.operators import enrich, mining
from waymark.plans.courses import km_sql
from waymark.plans.registry import query
from waymark.sources.markdown import labelled_field
from waymark.sources.tables import PLACES_SQL, places, table


@query("""SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<h2>([^<]*)</h2>', 1)), ''), nullif(trim(regexp_extract(html, '<h1>([^<&]*)</h1>', 1)), ''), nullif(trim(regexp_extract(html, '<title>([^<%]*)</title>', 1)), ''), url) AS said FROM pages""")
def page_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of four sources of a page's description that has any."""
    of = lambda pattern: F.regexp_extract("html", pattern, 1)
    said = enrich.first_text(of("<h2>([^<]*)</h2>"), of("<h1>([^<&]*)</h1>"), of("<title>([^<%]*)</title>"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", said.alias("said"))


@query("""SELECT conv_id, md5(arg_min(text, (CASE WHEN role = 'system' THEN 0 ELSE 1000000 END) + turn)) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def pinned_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's system message, else its first turn."""
    found = enrich.pinned_or_first(table(spark, sf_dir, "conversations"), ["conv_id"], "text", F.col("role") == "system", "turn")
    return found.select("conv_id", F.md5("text").alias("text"))


@query("""WITH r AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events)
SELECT user_id, event_id, value FROM r WHERE rank <= 5 AND event_type <> 'error' AND value >= 10 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank) = 1""")
def hot_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event, of the first five, that is no error and large enough."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))  # a few are kept of each user
    results = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", rank.alias("rank"))
    return enrich.first_valid(results, ["user_id"], "rank", (F.col("event_type") != "error") & (F.col("value") >= 10)).select("user_id", "event_id", "value")


@query("""SELECT c_custkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS rating, CASE WHEN s_suppkey IS NOT NULL THEN 'map/' || s_suppkey END AS link FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def rating_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the balance of the supplier of their number as a rating, where it is above zero, and a link."""
    ratings = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("rating"), F.concat(F.lit("map/"), "s_suppkey").alias("link"))
    return enrich.with_rating(table(spark, sf_dir, "customer").select("c_custkey"), ratings, "c_custkey", "rating")


@query("""WITH a AS (SELECT doc_id, 1 AS source, CASE WHEN quality = 1 THEN 'good' END AS mark, NULL AS tone FROM labels UNION ALL SELECT doc_id, 2, 'seen', CASE WHEN toxic = 1 THEN 'rough' ELSE 'mild' END FROM labels UNION ALL SELECT doc_id, 3, lang, 'long' FROM documents WHERE n_chars > 3000),
  f AS (SELECT doc_id, arg_min(mark, source) FILTER (mark IS NOT NULL) AS mark, arg_min(tone, source) FILTER (tone IS NOT NULL) AS tone FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(f.mark, 'unknown') AS mark, coalesce(f.tone, d.lang) AS tone FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id""")
def first_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields of every document from the first of three sources that has each, else by a rule."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    one = labels.select("doc_id", F.lit(1).alias("source"), F.when(F.col("quality") == 1, "good").alias("mark"), F.lit(None).cast("string").alias("tone"))
    two = labels.select("doc_id", F.lit(2), F.lit("seen"), F.when(F.col("toxic") == 1, "rough").otherwise("mild"))
    three = docs.filter("n_chars > 3000").select("doc_id", F.lit(3), "lang", F.lit("long"))
    found = enrich.with_answers(docs.select("doc_id", "lang"), one.union(two).union(three), "doc_id", {"mark": F.lit("unknown"), "tone": F.col("lang")})
    return found.select("doc_id", "mark", "tone")


@query("SELECT doc_id, md5(text) AS text FROM documents WHERE text IS NOT NULL")
def unescaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts escaped as pieces of JSON strings, and read back."""
    whole = F.to_json(F.struct("text"))
    piece = F.expr("substring(j, 10, length(j) - 11)")  # between {"text":" and "}
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", whole.alias("j"))
    return rows.select("doc_id", F.md5(nested.unescaped(piece)).alias("text"))


SAVED_SQL = "saved AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids, l_orderkey % 11 = 0 AS broken FROM lineitem GROUP BY l_orderkey)"


def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey and its lines' parts as a stored JSON list; some are cut off, as a browser's store may be."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: F.struct(s["l_partkey"].alias("id")))
    text = F.to_json(ids)
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(text.alias("text"))
    return rows.withColumn("text", F.when(F.col("l_orderkey") % 11 == 0, F.expr("substring(text, 1, length(text) - 4)")).otherwise(F.col("text")))


@query(f"WITH {SAVED_SQL} SELECT l_orderkey, CASE WHEN broken THEN '' ELSE array_to_string(ids, ',') END AS ids FROM saved")
def saved_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored courses; broken ones are empty."""
    items = F.transform(enrich.saved_lists(F.col("text"), "struct<id:bigint>"), lambda s: s["id"])
    return saved(spark, sf_dir).select("l_orderkey", F.array_join(items.cast("array<string>"), ",").alias("ids"))


@query(f"""WITH {SAVED_SQL}, steps AS (SELECT l_orderkey, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM saved WHERE NOT broken), known AS (SELECT p_partkey AS id, p_type <> 'ECONOMY' AS ok FROM part WHERE p_size > 5),
  found AS (SELECT l_orderkey, string_agg(s.id::VARCHAR, ',' ORDER BY pos) FILTER (ok) AS steps, count(*) FILTER (NOT ok) AS dropped FROM steps s LEFT JOIN known k ON k.id = s.id GROUP BY l_orderkey)
SELECT s.l_orderkey, coalesce(steps, '') AS steps, coalesce(dropped, 0) AS dropped FROM saved s LEFT JOIN found f ON f.l_orderkey = s.l_orderkey""")
def restored_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored courses against today's parts: unknown ones go silently, ineligible ones are counted."""
    ids = F.transform(enrich.saved_lists(F.col("text"), "struct<id:bigint>"), lambda s: s["id"])
    known = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("id"), "p_type")
    found = enrich.restored(saved(spark, sf_dir).select("l_orderkey", ids.alias("ids")), known, ["l_orderkey"], F.col("p_type") != "ECONOMY")
    return found.select("l_orderkey", F.array_join(F.col("steps").cast("array<string>"), ",").alias("steps"), "dropped")


@query(f"""WITH {PLACES_SQL}, steps AS (SELECT l_orderkey, l_suppkey AS id, lat, lng, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS k FROM lineitem JOIN spots ON id = l_suppkey WHERE lat IS NOT NULL),
  legs AS (SELECT o_orderkey, s.id, {km_sql("u.lat", "u.lng", "s.lat", "s.lng")} AS km FROM orders JOIN spots u ON u.id = o_custkey JOIN steps s ON s.l_orderkey = o_orderkey AND k = 1 WHERE u.lat IS NOT NULL)
SELECT o_orderkey, id, round(km, 3) AS km, CASE WHEN km < 1 THEN 'walk' WHEN km < 30 THEN 'drive' ELSE 'hours' END AS mode FROM legs""")
def user_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way from each order's customer to its first located step, suppliers being the places of their number."""
    spots = places(spark, sf_dir).select("id", "lat", "lng")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("id"))
    users = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id")).join(spots, "id").drop("id")
    return enrich.first_leg(lines.join(spots, "id"), users, ["o_orderkey"]).select("o_orderkey", "id", F.round("km", 3).alias("km"), "mode")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def top_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.digest(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.col("p_partkey")]).select("p_partkey", "p_retailprice")


@query("""SELECT p_partkey, CASE WHEN p_size >= 10 THEN p_type || ' of ' || p_brand END AS category FROM part""")
def explicit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category that a section names by a bold label, where it has one."""
    line = F.when(F.col("p_size") >= 10, F.concat(F.lit("- **kind**: "), "p_type", F.lit(" of "), "p_brand", F.lit(" \n"))).otherwise("- kind: none\n")
    body = F.concat(F.lit("## "), "p_name", F.lit("\n"), line, F.lit("the **end**"))
    return table(spark, sf_dir, "part").select("p_partkey", labelled_field(body, ["class", "kind"]).alias("category"))


@query("""WITH t AS (SELECT page_id, list_filter([trim(x) for x in regexp_extract_all(html, '="([^"]{2,15})"', 1)], lambda x: len(x) BETWEEN 2 AND 15 AND NOT contains(x, 'ad')) AS quoted,
  list_filter(regexp_split_to_array(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^a-zA-Z]+'), lambda x: len(x) BETWEEN 2 AND 10) AS words FROM pages),
  u AS (SELECT page_id, list_concat(quoted, words) AS all_words FROM t), d AS (SELECT page_id, list_filter(all_words, lambda x, i: list_position(all_words, x) = i) AS first FROM u)
SELECT page_id, array_to_string(first[:12], '|') AS names FROM d""")
def web_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted words of a page and words of its title, each once, the first twelve."""
    quoted = mining.quoted_items(F.col("html"), ['="([^"]{2,15})"'], 2, 15, ["ad"])
    words = F.filter(F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "[^a-zA-Z]+"), lambda w: F.length(w).between(2, 10))
    names = F.slice(F.array_distinct(F.concat(quoted, words)), 1, 12)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(names, "|").alias("names"))


SUMMARY = "CASE p_type WHEN 'ECONOMY' THEN p_name || ', ' || p_brand WHEN 'SMALL' THEN ' ' || p_name || '? yes! ' WHEN 'LARGE' THEN '  ' WHEN 'MEDIUM' THEN p_name WHEN 'STANDARD' THEN p_size || ' ok' END"


@query(f"""WITH p AS (SELECT p_partkey, trim({SUMMARY}) AS raw, CASE WHEN p_size > 20 THEN p_type ELSE '' END AS category, list_filter(string_split(p_name, ' '), lambda w: w IN ('red', 'ring', 'hot', 'gear')) AS moods FROM part)
SELECT p_partkey, CASE WHEN raw <> '' AND NOT regexp_matches(raw, '^[a-zA-Z0-9,#\\s_-]+$') THEN raw WHEN category <> '' AND len(moods) > 0 THEN array_to_string(moods, ' · ') || ' and ' || category WHEN category <> '' THEN 'a fine ' || category WHEN len(moods) > 0 THEN 'for ' || array_to_string(moods, ' · ') ELSE 'a place' END AS summary FROM p""")
def copy_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a part says of itself, or a sentence of its type and moods."""
    moods = F.filter(F.split("p_name", " "), lambda w: w.isin("red", "ring", "hot", "gear"))
    category = F.when(F.col("p_size") > 20, F.col("p_type")).otherwise("")
    said = labels.said_or_made(F.expr(SUMMARY), category, moods, r"^[a-zA-Z0-9,#\s_-]+$", "{moods} and {category}", "a fine {category}", "for {moods}", "a place")
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("summary"))


@query(f"""WITH p AS (SELECT p_partkey, p_name, coalesce(trim({SUMMARY}), '') AS raw, CASE WHEN p_size > 40 THEN p_brand || ' has ' || p_type WHEN p_size > 20 THEN 'known ' || p_type ELSE 'some ' || p_type END AS made FROM part)
SELECT p_partkey, CASE WHEN len(raw) < 5 OR lower(raw) = lower(p_name) OR regexp_matches(raw, '^[a-zA-Z_\\s,]+$') OR raw IN ('12 ok', '13 ok') OR contains(raw, 'blue') OR contains(raw, 'old') THEN made ELSE raw END AS summary FROM p""")
def shown_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with tag words at any length and phrases that say nothing."""
    made = F.when(F.col("p_size") > 40, F.concat("p_brand", F.lit(" has "), "p_type")).when(F.col("p_size") > 20, F.concat(F.lit("known "), "p_type")).otherwise(F.concat(F.lit("some "), "p_type"))
    said = labels.shown_summary(F.expr(SUMMARY), F.col("p_name"), ["blue", "old"], ["12 ok", "13 ok"], made)
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("summary"))
