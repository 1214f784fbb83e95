"""Queries about merges, queues and event histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import lifecycle, repair
from waymark.plans.registry import query
from waymark.sources.tables import PLACES_SQL, places, table
from waymark.streaming import rate


@query("""SELECT id, balance, status FROM (SELECT c_custkey AS id, c_acctbal AS balance, '-' AS status, 0 AS src, TIMESTAMP '1900-01-01' AS ts, 0 AS k FROM customer UNION ALL SELECT o_custkey, o_totalprice, o_orderstatus, 1, o_orderdate, o_orderkey FROM orders) z
QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, src DESC, k DESC) = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.lit("1900-01-01 00:00:00").cast("timestamp")
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit("-").alias("status"), F.struct(old.alias("ts"), F.lit(0).cast("long").alias("k")).alias("at"))
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("balance"), F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("k")).alias("at"))
    return repair.latest(base, changes, "id", "at").select("id", "balance", "status")


@query(f"WITH {PLACES_SQL}, p AS (SELECT o_custkey AS id, max(o_totalprice) AS balance FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT s.id, coalesce(p.balance, s.balance) AS balance, s.slot FROM spots s LEFT JOIN p ON p.id = s.id")
def patch_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("balance"))
    return repair.patch(places(spark, sf_dir).select("id", "balance", "slot"), changes, "id")


@query("SELECT s_name AS name FROM supplier UNION ALL (SELECT DISTINCT 'Supplier#' || lpad(c_custkey::VARCHAR, 9, '0') AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_name = 'Supplier#' || lpad(c_custkey::VARCHAR, 9, '0')))")
def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("name"), F.lit(1).alias("unknown"))
    return repair.append_new(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")), rows, "name")


OVER_SQL = f"{PLACES_SQL}, r AS (SELECT id, name, replace(name, 'Customer', 'C') AS clean, slot, region FROM spots), o AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'C#' WHEN 1 THEN 'Customer#' ELSE 'Nobody#' END || lpad(s_suppkey::VARCHAR, 9, '0') AS name, s_suppkey % 5 = 0 AS exclude, CASE WHEN s_suppkey % 2 = 0 THEN 'night' END AS slot, 'MOON' AS region FROM supplier)"


def overridden(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = places(spark, sf_dir)
    rows = p.select("id", F.replace("name", F.lit("Customer"), F.lit("C")).alias("name"), F.col("name").alias("raw_name"), "slot", "region")
    key = F.col("s_suppkey")
    name = F.concat(F.when(key % 3 == 0, "C#").when(key % 3 == 1, "Customer#").otherwise("Nobody#"), F.lpad(key.cast("string"), 9, "0"))
    over = table(spark, sf_dir, "supplier").select(name.alias("name"), (key % 5 == 0).alias("exclude"), F.when(key % 2 == 0, "night").alias("slot"), F.lit("MOON").alias("region"))
    return repair.apply_overrides(rows, over, ["slot", "region"])


@query(f"WITH {OVER_SQL} SELECT r.id, coalesce(o.slot, r.slot) AS slot, coalesce(o.region, r.region) AS region FROM r LEFT JOIN o ON o.name IN (r.clean, r.name) WHERE NOT coalesce(o.exclude, FALSE)")
def override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overridden(spark, sf_dir)[0].select("id", "slot", "region")


@query(f"WITH {OVER_SQL} SELECT name FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE o.name IN (r.clean, r.name))")
def override_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overridden(spark, sf_dir)[1]


@query("SELECT event_id, 'a=' || event_type || ',b=' || (event_id % 7) || ',c=new' AS merged FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'a=' || event_type || ',b=old' FROM events WHERE event_id % 2 = 1")
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("old"), F.lit("d"), F.lit("gone"))
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("b"), (F.col("event_id") % 7).cast("string"), F.lit("c"), F.lit("new")))
    merged = repair.drop_key(repair.merge_maps(old, new), "d")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("merged"))


@query("SELECT c_custkey AS id FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) o ON o_custkey = c_custkey ORDER BY last NULLS FIRST, id LIMIT 500")
def queue_stalest(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("last"))
    return lifecycle.stalest(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(last, "id", "left"), "last", 500).select("id")


@query("SELECT event_id FROM events ORDER BY json_extract_string(props, '$.k') NULLS FIRST, event_id LIMIT 300")
def json_path_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.stalest(table(spark, sf_dir, "events"), F.get_json_object("props", "$.k"), 300, "event_id").select("event_id")


@query("SELECT coalesce(max(c_custkey), 1000) AS top, count(*) FILTER (c_acctbal > 0) AS positive FROM customer")
def key_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").agg(F.coalesce(F.max("c_custkey"), F.lit(1000)).alias("top"), F.count_if(F.col("c_acctbal") > 0).alias("positive"))


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as checks of places: an error or a click counts as a miss."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), (~F.col("event_type").isin("error", "click")).alias("found"))


@query("""WITH c AS (SELECT user_id AS key, ts, event_id AS id, event_type NOT IN ('error', 'click') AS found FROM events), r AS (SELECT *, count(*) FILTER (found) OVER (PARTITION BY key ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM c),
f AS (SELECT *, count(*) FILTER (NOT found) OVER (PARTITION BY key, run ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS fails, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS k FROM r),
e AS (SELECT *, min(k) FILTER (fails >= 3) OVER (PARTITION BY key) AS stop FROM f)
SELECT key, arg_max(fails, k) AS fails, max(stop IS NOT NULL) AS closed, count(*) AS n, max(ts) AS last_ts FROM e WHERE stop IS NULL OR k <= stop GROUP BY key""")
def closure_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.closure(checks(spark, sf_dir))


@query("SELECT event_type, user_id, max(ts) AS ts FROM events GROUP BY event_type, user_id QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY max(ts) DESC, user_id) <= 100")
def recent_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.recent(table(spark, sf_dir, "events"), "event_type", "user_id", "ts").select("event_type", "user_id", "ts")


@query("SELECT o_orderkey AS key FROM orders ORDER BY o_orderdate DESC, key LIMIT 800")
def cache_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.trim_cache(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("ts")), "ts").select("key")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS load FROM events")
def offered_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return lifecycle.offered_load(requests, 3600).select("event_id", "load")


@query()
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential state of each user that SQL can't express; limits that the driver's event rate reaches."""
    requests = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return rate.admission(requests, [(2, 6 * 3_600_000_000, "hours"), (4, 3 * 86_400_000_000, "days")])
