"""Place tables from files, with an enforced schema, and policies that every reader applies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns a place may have; absent ones are null.
PLACE = """id BIGINT, name STRING, slot STRING, region STRING, area STRING, address STRING, mood ARRAY<STRING>, location STRING, price STRING,
summary STRING, category STRING, image_url STRING, lat DOUBLE, lng DOUBLE, quality_score INT, fail_count INT,
source STRUCT<type: STRING, url: STRING, note: STRING>, verified BOOLEAN, is_closed BOOLEAN"""
TIERS = ["low", "medium", "high", "luxury", "free"]


def read_json(spark: SparkSession, path: str, schema: str = PLACE, multi_line: bool = True) -> DataFrame:
    """Rows of a JSON file or folder; a malformed file fails the read instead of giving part of it."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=multi_line)


def read_jdbc(spark: SparkSession, url: str, name: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table scanned in parallel by ranges of id; filters on it are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn="id", lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def active(places: DataFrame) -> DataFrame:
    """Places that are not closed; unknown counts as open."""
    return places.filter(~F.coalesce("is_closed", F.lit(False)))


def union_pages(*pages: DataFrame, key: str = "id") -> DataFrame:
    """All pages, one row for each key; pages may lack columns."""
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page, allowMissingColumns=True)
    return out.dropDuplicates([key])


def split_valid(places: DataFrame, allowed: dict[str, list[str]], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with a reason): required columns not null, listed columns null or among their values."""
    reason = F.lit(None).cast("string")
    for column, values in reversed(allowed.items()):
        reason = F.when(F.col(column).isNotNull() & ~F.col(column).isin(values), f"{column} not allowed").otherwise(reason)
    for column in reversed(required):
        reason = F.when(F.col(column).isNull(), f"{column} missing").otherwise(reason)
    marked = places.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")
