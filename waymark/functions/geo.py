"""Distances, travel estimates and boxes. A coordinate is missing only if it is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import shuffles

EARTH_KM = 6371.0
#: Values of an array at about most; of the shorter of two that are taken apart together, as a task holds all rows of the two at once.
ARRAY, SHORT = 4096, 16


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance; null if any coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def within_km(left: DataFrame, right: DataFrame, km: float, on: list[str] | None = None, times: int = 1) -> DataFrame:
    """Pairs of left (lat, lng) and right (lat_r, lng_r) at most km apart, with column km.

    Both fall into cubes of the radius' size around the globe, as points on its surface in three
    dimensions, so that poles and the 180th meridian are no edges. The left side is repeated in
    the 27 cubes around its own: the join is an equi-join on the cube with the exact distance as
    a residual. `on` adds equi-join columns of both sides. Both sides grow, so neither is broadcast;
    small cubes may hold much work, so the partitions stay as many as the session's, or `times` as many.
    """
    size = km * (1 + 1e-6) + 1e-6  # a straight line is never longer than the arc

    def cube(lat: Column, lng: Column) -> list[Column]:
        lat, lng = F.radians(lat), F.radians(lng)
        return [F.floor(EARTH_KM * v / size) for v in (F.cos(lat) * F.cos(lng), F.cos(lat) * F.sin(lng), F.sin(lat))]

    steps = F.array(*map(F.lit, (-1, 0, 1)))
    near, far = left.filter("lat is not null and lng is not null"), right.filter("lat_r is not null and lng_r is not null")
    cells = ["__x", "__y", "__z"]
    for name, mine, its in zip(cells, cube(F.col("lat"), F.col("lng")), cube(F.col("lat_r"), F.col("lng_r")), strict=True):
        near = near.withColumn("__d", F.explode(steps)).withColumn(name, mine + F.col("__d")).drop("__d")
        far = far.withColumn(name, its)
    keys = [*(on or []), *cells]
    pairs = near.join(far.repartition(times * shuffles(far), *keys).hint("merge"), keys).drop(*cells)
    return pairs.withColumn("km", haversine_km(F.col("lat"), F.col("lng"), F.col("lat_r"), F.col("lng_r"))).filter(F.col("km") <= km)


def gathered(df: DataFrame, by: list[str], of: str, name: str, most: int = ARRAY) -> DataFrame:
    """`by` (without nulls) and name: the values of `of` in arrays of about `most` at most, several rows for larger groups."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"))
    part = F.pmod(F.xxhash64(of, *by), F.ceil(F.col("__n") / most))  # `by` may hold a remainder of the same hash
    return df.join(sizes.hint("merge"), by).groupBy(*by, part.alias("__part")).agg(F.collect_list(of).alias(name)).drop("__part")


def pairs_within_km(left: DataFrame, right: DataFrame, km: float, on: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """The columns `on`, id, id_r and km (rounded to `digits`, once for two points) of the pairs of left (id, lat, lng) and right (id_r, lat_r, lng_r) at most km apart.

    Rows of one point meet as one: pairs of points are found, with the ids of both in arrays, and
    taken apart where they are found. What is shuffled grows with the rows, not with their pairs, and
    what a task holds is bounded by the lengths of two arrays.
    """
    on = on or []
    mine = gathered(left.filter("lat is not null and lng is not null"), [*on, "lat", "lng"], "id", "ids", SHORT)
    its = gathered(right.filter("lat_r is not null and lng_r is not null"), [*on, "lat_r", "lng_r"], "id_r", "ids_r")
    met = within_km(mine, its, km, on)
    if digits is not None:
        met = met.withColumn("km", F.round("km", digits))
    return met.select(*on, "km", F.explode("ids").alias("id"), "ids_r").select(*on, "id", F.explode("ids_r").alias("id_r"), "km")


def half_up(x: Column, digits: int = 0) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def travel(km: Column) -> Column:
    """struct(mode, amount): walking minutes under 1 km, driving minutes under 30 km, else hours to one decimal."""
    walk = F.greatest(F.lit(1.0), half_up(km * 15))
    drive = F.greatest(F.lit(3.0), half_up(km / 25 * 60 + 3))
    mode = F.when(km < 1, "walk").when(km < 30, "drive").when(km.isNotNull(), "hours")
    return F.struct(mode.alias("mode"), F.when(km < 1, walk).when(km < 30, drive).otherwise(half_up(km / 60, 1)).alias("amount"))


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    """box: south, north, west, east, all inclusive."""
    south, north, west, east = box
    return lat.between(south, north) & lng.between(west, east)


def matches_box(lat: Column, lng: Column, region: Column, boxes: dict[str, tuple[float, float, float, float]], country: tuple[float, float, float, float]) -> Column:
    """True or False; null if the point is missing, (0, 0) or abroad, or the region is unknown."""
    usable = lat.isNotNull() & lng.isNotNull() & ~((lat == 0) & (lng == 0)) & in_box(lat, lng, country)
    found = F.lit(None).cast("boolean")
    for name, box in boxes.items():
        found = F.when(region == name, in_box(lat, lng, box)).otherwise(found)
    return F.when(usable, found)


def box_regions(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every (point, box) with the point inside; boxes (box_region, south, north, west, east) are a small dimension of fixed size."""
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lng").between(F.col("west"), F.col("east"))
    return points.join(F.broadcast(boxes), inside)


def first_box(lat: Column, lng: Column, boxes: list[tuple[str, tuple[float, float, float, float]]], default: str) -> Column:
    """The name of the first box that holds the point."""
    out = F.lit(default)
    for name, box in reversed(boxes):
        out = F.when(in_box(lat, lng, box), name).otherwise(out)
    return out
