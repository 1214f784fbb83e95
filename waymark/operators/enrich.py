"""What places gain from other tables: first answers, ratings, saved courses, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import haversine_km, travel


def first_text(*paths: Column) -> Column:
    """The first of several sources that has more than blanks, trimmed; null if none has."""
    return F.coalesce(*(F.nullif(F.trim(p), F.lit("")) for p in paths))


def pinned_or_first(comments: DataFrame, by: list[str], text: str, pinned: Column, pos: str) -> DataFrame:
    """by and text of each group's pinned comment, else of its first one, by position; blank ones don't count."""
    rows = comments.filter(F.trim(text) != "").withColumn("__p", F.coalesce(pinned, F.lit(False)))
    return rows.groupBy(*by).agg(F.min_by(text, F.struct(~F.col("__p"), pos, text)).alias(text))


def first_valid(results: DataFrame, by: list[str], rank: str, valid: Column, most: int = 5) -> DataFrame:
    """Of each search the first of its `most` best ranked results that is valid; searches without one give no row."""
    rest = [c for c in results.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct(rank, *(c for c in rest if c != rank))).alias("x")
    return results.filter((F.col(rank) <= most) & F.coalesce(valid, F.lit(False))).groupBy(*by).agg(best).select(*by, "x.*")


def with_rating(places: DataFrame, ratings: DataFrame, key: str, rating: str) -> DataFrame:
    """places with rating and link: a rating that isn't above zero is unknown, not low; a known place keeps its link."""
    known = ratings.select(key, F.when(F.col(rating) > 0, F.col(rating)).alias(rating), "link")
    return places.join(known, key, "left")


def with_answers(rows: DataFrame, answers: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """rows with each field from the first answering source, else from a rule.

    answers: key, source (in order of preference) and the fields, null where a source has none.
    """
    first = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("source"))).alias(f"__{c}") for c in fields]
    found = rows.join(answers.groupBy(key).agg(*first), key, "left")
    return found.withColumns({c: F.coalesce(F.col(f"__{c}"), rule) for c, rule in fields.items()}).drop(*(f"__{c}" for c in fields))


def saved_lists(text: Column, item: str) -> Column:
    """The items of a stored JSON list; anything else, broken texts included, is an empty list."""
    none = F.array().cast(f"array<{item}>")
    return F.coalesce(F.from_json(text, f"array<{item}>", {"mode": "PERMISSIVE"}), none)


def restored(saved: DataFrame, places: DataFrame, by: list[str], eligible: Column) -> DataFrame:
    """by, steps (ids of eligible places in order) and dropped: how many known places are no longer eligible.

    saved: by and ids; places: id and what `eligible` looks at. Unknown ids go without a trace.
    """
    steps = saved.select(*by, F.posexplode_outer("ids").alias("pos", "id"))
    known = places.select("id", F.coalesce(eligible, F.lit(False)).alias("__ok"))
    found = steps.join(known, "id", "left")
    kept = F.transform(F.sort_array(F.collect_list(F.when(F.col("__ok"), F.struct("pos", "id")))), lambda s: s["id"])
    return found.groupBy(*by).agg(kept.alias("steps"), F.count_if(~F.col("__ok")).alias("dropped"))


def first_leg(steps: DataFrame, users: DataFrame, by: list[str]) -> DataFrame:
    """by, id, km, mode and amount from a user's place (lat, lng) to the first step that has one.

    steps: by, pos, id, lat, lng. Users without a place, and courses without a located step, give no row.
    """
    located = steps.filter("lat is not null and lng is not null")
    first = located.groupBy(*by).agg(F.min(F.struct("pos", "id", "lat", "lng")).alias("x"))
    own = users.filter("lat is not null and lng is not null").select(*by, F.col("lat").alias("u_lat"), F.col("lng").alias("u_lng"))
    km = haversine_km(F.col("u_lat"), F.col("u_lng"), F.col("x.lat"), F.col("x.lng"))
    return own.join(first, by).withColumn("km", km).withColumn("t", travel(F.col("km"))).select(*by, "x.id", "km", "t.mode", "t.amount")


def digest(df: DataFrame, order: list[Column], most: int = 5) -> DataFrame:
    """The first few rows for a daily report."""
    return df.orderBy(*order).limit(most)


def write_json(df: DataFrame, path: str, lists: dict[str, int]) -> None:
    """Writes rows as JSON lines, with no more than so many items of each named list; what is there is replaced."""
    df.withColumns({c: F.slice(c, 1, n) for c, n in lists.items()}).write.mode("overwrite").json(path)
