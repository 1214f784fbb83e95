"""Places and the zones that their areas or texts fall into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import area_forms, area_of
from waymark.operators import gazetteer

# Fixed values, which must be the same to give the same results: suffixes of cities and counties,
# and what a homograph may go on with where it is a place all the same.
CITY_SUFFIXES = ["시", "군"]
GENUINE = r"(?:광역시|\s|[시구동길로]|$)"


def literal(word: Column) -> Column:
    """A word as a literal regular expression."""
    return F.concat(F.lit(r"\Q"), word, F.lit(r"\E"))


def mentions(text: Column, word: Column, asides: list[str], compounds: Column | None = None) -> Column:
    """Whether a text has the word other than before an aside such as "near" or "departing".

    compounds: words of other things that begin with it; a text with one of these must also have
    the word followed by what places are followed by.
    """
    left = F.regexp_replace(text, F.concat(literal(word), F.lit(rf"\s*(?:{'|'.join(asides)})")), F.lit(""))
    there = F.contains(left, word)
    if compounds is not None:
        odd = F.exists(compounds, lambda c: F.contains(left, c))
        there = there & (~F.coalesce(odd, F.lit(False)) | F.regexp_like(left, F.concat(literal(word), F.lit(GENUINE))))
    return F.coalesce(there, F.lit(False))


def in_zones(places: DataFrame, zones: DataFrame, asides: list[str]) -> DataFrame:
    """All columns of places and zone, for every zone that holds a place, each pair once.

    places: id, region, area, location and name; zones: zone, regions (those it covers, empty is
    all), words and, if some have homographs, compounds (map of a word to words of other things).

    A zone outside the place's region holds nothing; a null region, or one that no zone names, is in
    every zone. A place lies in a zone whose word its area is a form of; without an area that is the
    first unit of its location. Any other place goes by its name and location: a word must be
    mentioned there. But a place in a city or county of its own only falls into zones with a word
    for it, or with one that begins like it.

    Areas meet forms in an equi-join. Words are found in texts by one automaton, however many there
    are, and only what is found is looked at closely. Nulls: a null area or location is none.
    """
    if "compounds" not in zones.columns:
        zones = zones.withColumn("compounds", F.lit(None).cast("map<string,array<string>>"))
    known = F.array_distinct(F.flatten(F.collect_list("regions")))
    every = zones.agg(F.coalesce(known, F.array().cast("array<string>")).alias("__known"))  # one row
    dim = zones.join(F.broadcast(every))
    words = dim.select("zone", "regions", "__known", F.col("words").alias("__words"), F.col("compounds").alias("__compounds"), F.explode("words").alias("__word"))
    open_ = F.coalesce(~F.array_contains("__known", F.col("region")), F.lit(True))
    covered = (F.size("regions") == 0) | open_ | F.coalesce(F.array_contains("regions", F.col("region")), F.lit(False))

    own = places.select("id", "region", area_of(F.col("area"), F.col("location")).alias("__area"), F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("location", F.lit(""))).alias("__text"))
    named = words.select("zone", "regions", "__known", F.explode(F.array_distinct(area_forms(F.col("__word")))).alias("__area"))
    by_area = own.join(named, "__area").filter(covered).select("id", "zone")

    names = gazetteer.gazetteer(words.select(F.col("__word").alias("word")).distinct())
    found = gazetteer.words_in(own, ["id", "region", "__area", "__text"], "__text", names)
    met = found.join(words, found["word"] == words["__word"]).filter(covered)
    city = F.coalesce(F.right("__area", F.lit(1)).isin(CITY_SUFFIXES), F.lit(False))
    base = F.substring("__area", F.lit(1), F.length("__area") - 1)
    related = F.exists("__words", lambda w: (w == F.col("__area")) | F.startswith(w, base))
    told = mentions(F.col("__text"), F.col("__word"), asides, F.try_element_at("__compounds", "__word"))
    by_text = met.filter((~city | related) & told).select("id", "zone")
    return places.join(by_area.union(by_text).distinct(), "id")
