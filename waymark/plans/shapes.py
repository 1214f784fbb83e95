"""Queries about nested inputs, searches with retry, pictures of courses and the mining pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import nested
from waymark.operators import audit, gazetteer, images, mining, resolve
from waymark.plans.registry import query
from waymark.sources.tables import table

WRAPPED = """CASE event_type WHEN 'view' THEN '{"a": {"b": [1, {"c": ' || props || '}]}, "k": null}' WHEN 'click' THEN '[[{"z": 0}, ' || props || '], {"k": -1}]'
WHEN 'purchase' THEN '{"x": {"y": {"z": {"k": "deep"}}}, "w": ' || props || '}' WHEN 'signup' THEN '{"b": {"k": null, "a": ' || props || '}, "m": [[' || props || '], {"k": [1]}]}' ELSE '{"m": ' || props END"""


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN '$[0][1].k' WHEN 'purchase' THEN '$.x.y.z.k' WHEN 'signup' THEN '$.m[0][0].k' END AS path,
CASE WHEN event_type IN ('click', 'signup') THEN json_extract(props, '$.k')::VARCHAR WHEN event_type = 'purchase' THEN '"deep"' END AS value FROM events""")
def nested_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key k at any depth of props wrapped in five ways, one of them broken JSON and one with a null first."""
    found = nested.find_key(F.expr(WRAPPED), "k")
    return table(spark, sf_dir, "events").select("event_id", found.alias("x")).select("event_id", "x.*")


@query("""WITH per AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first, round(sum(value), 4) AS total FROM events GROUP BY ALL)
SELECT user_id, event_type, event_type = 'error' AS malformed, CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 0 ELSE n END AS n, CASE WHEN event_type NOT IN ('error', 'signup') THEN first END AS first_id, CASE WHEN event_type NOT IN ('error', 'signup') THEN total END AS total FROM per""")
def item_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses whose items are a list, a single object, a blank string or cut off, as arrays again."""
    events = table(spark, sf_dir, "events")
    own = events.groupBy("user_id", "event_type").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("own"))  # one user's
    item = F.when(F.size("own") > 1, F.to_json("own")).otherwise(F.to_json(F.get("own", 0)))
    whole = F.concat(F.lit('{"response": {"body": {"items": '), F.when(F.col("event_type") == "signup", F.lit('""')).otherwise(F.concat(F.lit('{"item": '), item, F.lit("}"))), F.lit("}}}"))
    text = F.when(F.col("event_type") == "error", F.substring(whole, 1, 40)).otherwise(whole)
    found = nested.items_at(text, "$.response.body.items.item", "struct<event_id:bigint,value:double>")
    rows = own.select("user_id", "event_type", found.alias("x")).select("user_id", "event_type", "x.*")
    total = F.aggregate("items", F.lit(0.0), lambda acc, x: acc + x["value"])
    some = F.size("items") > 0
    return rows.select("user_id", "event_type", "malformed", F.when(F.col("items").isNotNull(), F.size("items")).cast("long").alias("n"), F.when(some, F.get("items", 0)["event_id"]).alias("first_id"), F.when(some, F.round(total, 4)).alias("total"))


IMAGES = {"ECONOMY": ["e1", "e2", "e3"], "SMALL": ["s1", "s2"], "LARGE": ["l1", "l2", "l3", "l4"]}
OWN_URL = "CASE WHEN p_size > 30 THEN 'http://img.example/' || p_size || '.jpg' WHEN p_size > 20 THEN 'http://blocked.example/' || p_size WHEN p_size > 15 THEN 'http://x' WHEN p_size > 10 THEN 'img ' || p_size END"


@query(f"""WITH RECURSIVE rows AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k, l_linenumber AS pos, l_partkey AS id,
    CASE WHEN p_size > 30 THEN {OWN_URL} END AS own, CASE p_type WHEN 'ECONOMY' THEN ['e1', 'e2', 'e3'] WHEN 'LARGE' THEN ['l1', 'l2', 'l3', 'l4'] ELSE ['s1', 's2'] END AS pool FROM lineitem JOIN part ON p_partkey = l_partkey),
  turned AS (SELECT *, pool[(id % len(pool)) + 1:] || pool[:(id % len(pool))] AS tried FROM rows),
  walk AS (SELECT l_orderkey, 0::BIGINT AS k, 0 AS pos, 0::BIGINT AS id, []::VARCHAR[] AS taken, ''::VARCHAR AS image FROM (SELECT DISTINCT l_orderkey FROM lineitem) z
    UNION ALL SELECT l_orderkey, k, pos, id, list_append(taken, pick), pick FROM (SELECT t.l_orderkey, t.k, t.pos, t.id, w.taken,
      CASE WHEN own IS NOT NULL AND NOT list_contains(w.taken, own) THEN own ELSE coalesce(list_filter(tried, lambda u: NOT list_contains(w.taken, u))[1], tried[1]) END AS pick FROM walk w JOIN turned t ON t.l_orderkey = w.l_orderkey AND t.k = w.k + 1) z)
SELECT l_orderkey, pos, id, image FROM walk WHERE k > 0""")
def course_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as courses, their lines as steps: each line's picture, none twice while its pool lasts."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    steps = lines.join(part, lines["l_partkey"] == part["p_partkey"]).select("l_orderkey", F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("id"), F.expr(OWN_URL).alias("url"), F.col("p_type").alias("pool"))
    return images.course_images(steps, ["l_orderkey"], IMAGES, "SMALL", ["blocked.example"])


HITS_SQL = """hits AS (SELECT p_name || ' ' || p_brand AS query, p_size AS rank, p_partkey AS id, p_type AS category FROM part WHERE p_size <= 12 UNION ALL SELECT p_name, p_size, p_partkey, p_type FROM part WHERE p_size > 45 AND p_name NOT LIKE 'red%'),
  tops AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank, id) = 1),
  searched AS (SELECT p_partkey, t.attempt, t.query, h.rank, h.id, h.category FROM (SELECT p_partkey, 1 AS attempt, p_name || ' ' || p_brand AS query FROM part UNION ALL SELECT p_partkey, 2, p_name FROM part) t JOIN tops h ON h.query = t.query QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY t.attempt) = 1)"""


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    hit = lambda q, rows: rows.select(q.alias("query"), F.col("p_size").alias("rank"), F.col("p_partkey").alias("id"), F.col("p_type").alias("category"))
    both = F.concat_ws(" ", "p_name", "p_brand")
    hits = hit(both, part.filter("p_size <= 12")).union(hit(F.col("p_name"), part.filter("p_size > 45 and p_name not like 'red%'")))
    return resolve.search_with_retry(part, hits, "p_partkey", [both, F.col("p_name")])


@query(f"WITH {HITS_SQL} SELECT p_partkey, attempt, query, rank, id, category FROM searched")
def search_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part looked up by name and brand, else by name alone: the first hit."""
    return searched(spark, sf_dir)


MINED_SQL = f"""{HITS_SQL}, known AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 50),
  marked AS (SELECT p.p_partkey, p.p_name, CASE WHEN list_has_any(string_split(lower(p.p_name), ' '), ['gizmo']) THEN 'gate' WHEN s.id IS NULL THEN 'search' WHEN s.category <> p.p_type AND s.attempt = 2 THEN 'category'
    WHEN NOT contains(s.query, string_split(p.p_name, ' ')[1]) THEN 'name' WHEN k.l_partkey IS NOT NULL THEN 'duplicate' ELSE 'kept' END AS outcome, s.id FROM part p LEFT JOIN searched s ON s.p_partkey = p.p_partkey LEFT JOIN known k ON k.l_partkey = s.id)"""


def mining_pass(spark: SparkSession, sf_dir: str):
    """(kept rows, observation) of the whole pass: gate, search with retry, category, name, known ones."""
    part, known = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select("l_partkey").distinct()
    found = searched(spark, sf_dir)
    rows = part.join(found, "p_partkey", "left").join(known, F.col("id") == F.col("l_partkey"), "left")
    stages = [
        ("gate", mining.name_gate(F.col("p_name"), ["gizmo"])["ok"]),
        ("search", F.col("id").isNotNull()),
        ("category", (F.col("category") == F.col("p_type")) | (F.col("attempt") == 1)),
        ("name", F.contains("query", F.get(F.split("p_name", " "), 0))),
        ("duplicate", F.col("l_partkey").isNull()),
    ]
    kept, seen = audit.observed_funnel(rows, stages, "mining")
    return kept.select("p_partkey", "p_name", "id"), seen


@query(f"WITH {MINED_SQL} SELECT p_partkey, p_name, id FROM marked WHERE outcome = 'kept'")
def mined_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that pass every stage, in one pass that counts each stage's losses on its way."""
    return mining_pass(spark, sf_dir)[0]


REGION_PREFIXES, UNITS = {"A": "other", "AS": "asia", "AF": "africa", "EU": "europe"}, ["1", "2", "5", "E"]


@query("""WITH rows AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN r_name || ' ' || n_name || '  ' || c_mktsegment WHEN c_acctbal >= -500 THEN r_name END AS address FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  parts AS (SELECT c_custkey, list_filter(regexp_split_to_array(coalesce(address, ''), '\\s+'), lambda t: t <> '') AS t FROM rows)
SELECT c_custkey, CASE WHEN t[1] LIKE 'AS%' THEN 'asia' WHEN t[1] LIKE 'AF%' THEN 'africa' WHEN t[1] LIKE 'EU%' THEN 'europe' WHEN t[1] LIKE 'A%' THEN 'other' END AS region, list_filter(t[2:], lambda x: len(x) >= 2 AND right(x, 1) IN ('1', '2', '5', 'E'))[1] AS area FROM parts""")
def address_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region by the longest prefix of an address's first token, area by its first later token with a unit's ending; some addresses are short or missing."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    wide = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    whole = F.concat("r_name", F.lit(" "), "n_name", F.lit("  "), "c_mktsegment")
    address = F.when(F.col("c_acctbal") >= 0, whole).when(F.col("c_acctbal") >= -500, F.col("r_name"))
    return wide.select("c_custkey", gazetteer.region_of_address(address, REGION_PREFIXES, UNITS).alias("x")).select("c_custkey", "x.*")
