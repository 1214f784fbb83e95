"""The driver's tables, and places made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = ["day", "evening", "night", "stay"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, slot, region, area, category, balance, lat, lng and moods of every customer."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    wide = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    key, nation = F.col("c_custkey"), F.col("n_nationkey")
    located = key % 11 != 0
    second = F.when(key % 3 == 0, "quiet").when(key % 3 == 1, "lively")
    return wide.select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.element_at(F.array(*map(F.lit, SLOTS)), (key % 4 + 1).cast("int")).alias("slot"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("area"),
        F.col("c_mktsegment").alias("category"),
        F.col("c_acctbal").alias("balance"),
        F.when(located, 33.5 + (nation % 5) * 1.0 + (key * 37 % 200) / 1e3).alias("lat"),
        F.when(located, 126.0 + F.floor(nation / 5.0) * 0.7 + (key * 91 % 200) / 1e3).alias("lng"),
        F.array_compact(F.array(F.lower("c_mktsegment"), second)).alias("moods"),
    )


#: The same rows in DuckDB.
PLACES_SQL = """
spots AS (SELECT c_custkey AS id, c_name AS name,
  CASE c_custkey % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'evening' WHEN 2 THEN 'night' ELSE 'stay' END AS slot,
  r_name AS region, n_name AS area, c_mktsegment AS category, c_acctbal AS balance,
  CASE WHEN c_custkey % 11 <> 0 THEN 33.5e0 + (n_nationkey % 5) * 1e0 + (c_custkey * 37 % 200) / 1e3 END AS lat,
  CASE WHEN c_custkey % 11 <> 0 THEN 126e0 + floor(n_nationkey / 5e0) * 7e-1 + (c_custkey * 91 % 200) / 1e3 END AS lng,
  list_filter([lower(c_mktsegment), CASE c_custkey % 3 WHEN 0 THEN 'quiet' WHEN 1 THEN 'lively' END], lambda x: x IS NOT NULL) AS moods
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
