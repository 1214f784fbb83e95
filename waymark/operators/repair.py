"""Addresses, overrides, merges and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = "(구|시|군)$"


def parse_address(address: Column, provinces: list[tuple[list[str], str, bool]]) -> Column:
    """struct(status, region, area) of an address.

    provinces: (prefixes, region, whether it is a metropolitan city) in order of priority. The
    first token names the province; the area is the next token ending in a unit (a metropolitan
    city's district, a province's city or county).
    """
    tokens = F.filter(F.split(F.trim(address), r"\s+"), lambda t: t != "")
    first = F.get(tokens, 0)
    region, metro = F.lit(None).cast("string"), F.lit(False)
    for prefixes, name, is_metro in reversed(provinces):
        hit = F.coalesce(first.rlike(f"^(?:{'|'.join(prefixes)})"), F.lit(False))
        region, metro = F.when(hit, name).otherwise(region), F.when(hit, is_metro).otherwise(metro)
    units = F.filter(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))), lambda t: (F.length(t) >= 2) & F.when(metro, t.rlike("(구|군)$")).otherwise(t.rlike("(시|군)$")))
    area = F.get(units, 0)
    empty = F.coalesce(F.trim(address), F.lit("")) == ""
    status = F.when(empty, "no_address").when(region.isNull(), "unparseable").when(area.isNull(), "no_area").otherwise("ok")
    return F.struct(status.alias("status"), F.when(~empty, region).alias("region"), F.when(~empty & region.isNotNull(), area).alias("area"))


def repair_class(status: Column, region: Column, area: Column, found_region: Column, found_area: Column, box_ok: Column) -> Column:
    """One class for each row: what its address says against what is stored, and whether coordinates object."""
    same = region.eqNullSafe(found_region) & area.eqNullSafe(found_area)
    return F.when(status != "ok", status).when(same, "match").when(~box_ok, "conflict").otherwise("fixable")


def hint_regions(text: Column, hints: dict[str, list[str]]) -> Column:
    """The regions any of whose words occur in a text, in order."""
    found = [F.when(F.coalesce(text.rlike("|".join(words)), F.lit(False)), name) for name, words in hints.items()]
    return F.array_compact(F.array(*found))


def latest(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert: one row for each key, the one with the highest `order`; changes win ties."""
    both = base.withColumn("__src", F.lit(0)).unionByName(changes.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "__src")]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.col("__src"))).alias("x")).select(key, *(f"x.{c}" for c in rest))


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of changes that are not null replace those of base; changes has one row for each key."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"__{c}") for c in fields))
    columns = [F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns]
    return base.join(new, key, "left").select(*columns)


def append_new(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Base and those rows whose key it lacks, each key once, in base's columns; unknown columns are dropped."""
    fresh = rows.join(base.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    have = [c for c in base.columns if c in fresh.columns]
    return base.unionByName(fresh.select(*have), allowMissingColumns=True)


def apply_overrides(rows: DataFrame, overrides: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with overrides by clean name, or else by raw name, and without excluded ones; keys that match nothing).

    rows: name, raw_name, fields; overrides: name (unique), exclude, fields.
    """
    over = lambda s, name: overrides.select(F.col("name").alias(name), F.coalesce("exclude", F.lit(False)).alias(f"__exclude{s}"), F.lit(True).alias(f"__hit{s}"), *(F.col(c).alias(f"__{c}{s}") for c in fields))
    joined = rows.join(over("1", "name"), "name", "left").join(over("2", "raw_name"), "raw_name", "left")
    pick = lambda c: F.when(F.col("__hit1"), F.col(f"__{c}1")).otherwise(F.col(f"__{c}2"))
    kept = joined.filter(~F.coalesce(pick("exclude"), F.lit(False)))
    used = rows.select("name").union(rows.select("raw_name")).distinct()
    return kept.select(*(F.coalesce(pick(c), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns)), overrides.select("name").join(used, "name", "left_anti")


def merge_maps(old: Column, new: Column) -> Column:
    """Both maps' entries; new ones win."""
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def drop_key(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != key)
