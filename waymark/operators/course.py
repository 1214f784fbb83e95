"""Courses: anchors, tiered seeded choice, assembly and the legs between steps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import SHORT, gathered, haversine_km, pairs_within_km, travel, within_km
from waymark.operators.pools import ANY
from waymark.operators.ranks import numbered
from waymark.session import cut, shuffles

#: What a step carries of its place.
PLACE = ["id", "area", "region", "lat", "lng"]
#: About how many ids one row holds at most.
MOST_IDS = 65_536
#: Greater than any hash.
NO_BOUND = "g"
#: The last tier of choice: any candidate at all.
LAST_TIER = 5


def draw(seed: Column, key: Column) -> Column:
    """A hash by which the smallest of several rows is a uniform choice that a seed repeats."""
    return F.md5(F.concat_ws("-", seed.cast("string"), key.cast("string")))


def opening(seed: Column) -> Column:
    """What the text that draw() hashes has before the key; never null."""
    return F.concat_ws("-", seed.cast("string"), F.lit(""))


def pick(pool: DataFrame, by: list[str], *carry: str) -> DataFrame:
    """One seeded random row of each group: an aggregate, with partial results before the shuffle."""
    best = F.min(F.struct(draw(F.col("seed"), F.col("id")).alias("h"), "id", *(c for c in carry if c != "id"))).alias("x")
    return pool.groupBy(*by).agg(best).select(*by, *(f"x.{c}" for c in dict.fromkeys(["id", *carry])))


def nearest(pairs: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """The k rows of each group with the smallest km (null last), by id on ties."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("km", "id"))
    return pairs.filter("km is not null").withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest_on_grid(anchors: DataFrame, others: DataFrame, on: list[str], k: int = 3, rings: tuple[float, ...] = (1, 4, 16, 64), own: bool = True) -> DataFrame:
    """anchor, id, km and rank of the k nearest others of each located anchor.

    anchors: anchor, lat, lng; others: id, lat_r, lng_r; both have the columns `on`, which must be
    equal. With `own` an anchor is the id of one of the others, which is left out. Points are
    searched for, with the first ids of each, so that copies of a point add no pairs. Grid joins of
    widening radius serve the points that lack k so far; the few that lack them after the last meet
    all other points of equal `on`.
    """
    most, columns = k + 1 if own else k, ["id", "km", "rank"]
    located = anchors.filter("lat is not null and lng is not null")
    keys = [*on, "lat", "lng"]
    # of one point's others the first ids suffice, and its anchors see the same ones
    first = F.row_number().over(Window.partitionBy(*on, "lat_r", "lng_r").orderBy("id"))
    few = cut(others.filter("lat_r is not null and lng_r is not null").select(*on, "id", "lat_r", "lng_r").withColumn("__k", first).filter(F.col("__k") <= most).drop("__k"))
    left, out = cut(located.select(*keys).distinct()), []
    for km in rings:
        found = cut(nearest(within_km(left, few, km, on), keys, most).select(*keys, *columns))
        full = found.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= most).select(*keys)
        out.append(found.join(full, keys, "left_semi"))
        left = cut(left.join(full, keys, "left_anti"))
    rest = left.join(few.hint("merge"), on).withColumn("km", haversine_km(F.col("lat"), F.col("lng"), F.col("lat_r"), F.col("lng_r")))
    around = reduce(DataFrame.union, [*out, nearest(rest, keys, most).select(*keys, *columns)])
    met = located.select("anchor", *keys).join(around.hint("merge"), keys).select("anchor", *columns)
    if not own:
        return met
    other = met.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "km"))).alias("x"))  # k + 1 of each
    return other.select("anchor", F.posexplode(F.slice(F.filter("x", lambda x: x["id"] != F.col("anchor")), 1, k)).alias("at", "y")).select("anchor", "y.id", "y.km", (F.col("at") + 1).alias("rank"))


#: What names a pool: its slot, region (ANY for all) and mood (ANY for all).
POOL = ["slot", "r", "m"]
STEP = ["request_id", "pos", "slot"]


def draw_number(seed: Column, pos: Column) -> Column:
    """32 bits that a seed repeats, of which the remainder by a pool's size is a place in it."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", seed.cast("string"), pos.cast("string"))), 1, 8), 16, 10).cast("long")


@dataclass
class Pools:
    """places: POOL, PLACE, at (place in the pool by area and id, from 0) and area_at (by id, of its area); points: POOL, area, region, lat, lng of the located ones, with ids in arrays; sizes: POOL, n; areas: POOL, area, n."""

    places: DataFrame
    points: DataFrame
    sizes: DataFrame
    areas: DataFrame


def rank_pools(places: DataFrame) -> Pools:
    """Every pool that the places (id, slot, region, area, lat, lng, moods) make, numbered once for all requests.

    A place stands under its region and under all, for each of its moods and for any. Numbers come
    from ranges of the order, so that no task sees a whole pool.
    """
    moods = F.array_distinct(F.concat(F.array(F.lit(ANY)), F.coalesce("moods", F.array().cast("array<string>"))))
    rows = places.withColumn("r", F.explode(F.array("region", F.lit(ANY)))).withColumn("m", F.explode(moods)).filter("slot is not null and r is not null and m is not null")
    ranked = cut(numbered(rows.select(*POOL, *PLACE), [*map(F.col, POOL), F.col("area"), F.col("id")], "rank"))
    areas = cut(ranked.groupBy(*POOL, "area").agg(F.min("rank").alias("first"), F.count("*").alias("n")))
    sizes = areas.groupBy(*POOL).agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    both = ranked.join(sizes.withColumnRenamed("first", "pool_first").drop("n"), POOL)
    own = areas.withColumnRenamed("first", "area_first").withColumnRenamed("area", "__area")
    both = both.join(own.withColumnsRenamed({c: f"__{c}" for c in POOL}), reduce(and_, (F.col(c) == F.col(f"__{c}") for c in POOL)) & F.col("area").eqNullSafe(F.col("__area")))
    placed = cut(both.select(*POOL, *PLACE, (F.col("rank") - F.col("pool_first")).alias("at"), (F.col("rank") - F.col("area_first")).alias("area_at"), F.col("n").alias("area_n")))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("area_n") / MOST_IDS)).alias("__part")  # arrays stay bounded in an area of any size
    points = placed.filter("lat is not null and lng is not null").groupBy(*POOL, "area", "region", "lat", "lng", part).agg(F.collect_list("id").alias("ids"))
    return Pools(placed.drop("area_n"), cut(points.drop("__part")), sizes.drop("first"), areas.drop("first"))


def asked_pools(requests: DataFrame, sizes: DataFrame) -> DataFrame:
    """STEP, seed, POOL and n of every pool that a step may draw from: one a region, its places are as many as n."""
    regions = F.when(F.size("regions") > 0, F.array_distinct("regions")).otherwise(F.array(F.lit(ANY)))
    rows = requests.select(*STEP, "seed", F.coalesce("mood", F.lit(ANY)).alias("m"), F.explode(regions).alias("r"))
    return rows.join(sizes, POOL).select(*STEP, "seed", "r", "m", "n")


def drawn_place(asked: DataFrame, pools: DataFrame, at: str, on: list[str]) -> DataFrame:
    """STEP, seed and PLACE: of the pools asked for (with n), one after another, the place that the seed's number falls on.

    `at` numbers the places of a pool, or of what `on` tells apart in it; a step's pools are few.
    """
    order = Window.partitionBy(*STEP).orderBy("r")
    ahead = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    all_ = F.sum("n").over(Window.partitionBy(*STEP))
    rows = asked.withColumn("__at", draw_number(F.col("seed"), F.col("pos")) % all_ - F.coalesce(ahead, F.lit(0))).filter("__at >= 0 and __at < n")
    side = pools.select(*on, F.col(at).alias("__at"), *(c for c in PLACE if c not in on))
    return rows.select(*dict.fromkeys([*STEP, "seed", *on, "__at"])).join(side, [*on, "__at"]).select(*STEP, "seed", *PLACE)


def smallest_pools(asked: DataFrame) -> DataFrame:
    """request_id, slot, pos, n of the step with the fewest candidates, the first on ties."""
    sizes = asked.groupBy(*STEP).agg(F.sum("n").alias("n"))
    return sizes.groupBy("request_id").agg(F.min(F.struct("n", "pos", "slot")).alias("x")).select("request_id", "x.slot", "x.pos", "x.n")


def drawn_near(steps: DataFrame, pools: Pools, km: float, expected: int = 64) -> DataFrame:
    """STEP, PLACE and km: of a pool's places within km of a step's (lat, lng) the one with the smallest hash of seed and id.

    Every such place is hashed, once for steps of one seed, pool and point. Points meet points, with
    seeds and ids in arrays; hashes are made where these are taken apart and dropped there unless
    they lie below a bound, under which about `expected` of a seed's hashes fall. So neither arrays
    nor pairs are sorted or moved. Seeds without a hash below their bound are drawn again without one.
    """
    points = pools.points.withColumnsRenamed({"lat": "lat_r", "lng": "lng_r"})
    spot = [*POOL, "lat", "lng"]
    opened = steps.filter("lat is not null and lng is not null").select(*STEP, "r", "m", "lat", "lng", opening(F.col("seed")).alias("start"))
    asked = opened.select(*spot, "start").distinct()
    near = within_km(asked.select(*spot).distinct(), points.withColumn("n", F.size("ids")).drop("ids"), km, POOL).groupBy(*spot).agg(F.sum("n").alias("n"))
    bound = F.when(F.col("n") > expected, F.lpad(F.lower(F.hex(F.floor(expected / F.col("n") * 2**32))), 8, "0")).otherwise(NO_BOUND)
    bounded = asked.join(near.select(*spot, bound.alias("bound")).hint("merge"), spot)

    def smallest(asked: DataFrame) -> DataFrame:
        seeds = gathered(asked, [*spot, "bound"], "start", "starts", 256)
        met = within_km(seeds, points, km, POOL, 2).withColumn("start", F.explode("starts")).drop("starts").withColumn("id", F.explode("ids"))
        hashed = met.withColumn("h", F.md5(F.concat("start", F.col("id").cast("string")))).filter("h < bound")
        return hashed.groupBy(*spot, "start").agg(F.min(F.struct("h", "id", "area", "region", "lat_r", "lng_r", "km")).alias("d"))

    bounded = cut(bounded)
    drawn = smallest(bounded)
    if not bounded.isEmpty():
        drawn = cut(drawn)
        rest = bounded.join(drawn.hint("merge"), [*spot, "start"], "left_anti")
        if not rest.isEmpty():
            drawn = drawn.union(smallest(rest.withColumn("bound", F.lit(NO_BOUND))))
    best = opened.join(drawn.hint("merge"), [*spot, "start"]).groupBy(*STEP).agg(F.min("d").alias("x"))
    named = {"lat_r": "lat", "lng_r": "lng"}
    return best.select(*STEP, *(F.col(f"x.{c}").alias(named.get(c, c)) for c in ("id", "area", "region", "lat_r", "lng_r", "km")))


def choose_near(steps: DataFrame, pools: Pools) -> DataFrame:
    """STEP, tier, PLACE and km of steps (STEP, seed, r, m, n, lat, lng, anchor_area, anchor_region).

    Tiers: 1 within 5 km of (lat, lng), 2 the anchor's area, 3 within 10 km, 4 the three nearest in
    the anchor's region or else anywhere, 5 all; a tier is looked at for the steps only that have none
    so far. Places meet a step through grid cells; of an area or a whole pool only the one place is
    fetched that the step's number falls on. In tiers 1, 3 and 4 the smallest hash of seed and id is
    drawn.
    """
    columns = [*STEP, "tier", *PLACE, "km"]
    centre = steps.select(*STEP, F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng")).distinct()

    def one(asked: DataFrame, at: str, on: list[str], tier: int) -> DataFrame:
        km = haversine_km(F.col("c_lat"), F.col("c_lng"), F.col("lat"), F.col("lng"))
        return drawn_place(asked, pools.places, at, on).join(centre, STEP).withColumn("km", km).withColumn("tier", F.lit(tier)).select(columns)

    def without(left: DataFrame, found: DataFrame) -> DataFrame:
        return cut(left.join(found.select(*STEP), STEP, "left_anti"))

    steps = cut(steps)
    close = cut(drawn_near(steps, pools, 5).withColumn("tier", F.lit(1)).select(columns))
    left = without(steps, close)
    in_area = cut(one(left.drop("n").withColumnRenamed("anchor_area", "area").join(pools.areas, [*POOL, "area"]), "area_at", [*POOL, "area"], 2))
    left = without(left, in_area)
    around = cut(drawn_near(left, pools, 10).withColumn("tier", F.lit(3)).select(columns))
    left = without(left, around)
    best = close.union(in_area).union(around).union(cut(one(left, "at", POOL, 6)))
    far = left.filter("lat is not null and lng is not null")
    if not far.isEmpty():
        # once in the anchor's region and once anywhere
        anchors = far.withColumn("scope", F.explode(F.array("anchor_region", F.lit(ANY)))).withColumn("anchor", F.struct(*STEP, "scope"))
        spots = pools.places.select(*POOL, "id", "area", "region", F.col("lat").alias("lat_r"), F.col("lng").alias("lng_r"))
        offered = spots.withColumn("scope", F.explode(F.array("region", F.lit(ANY))))
        found = nearest_on_grid(anchors, offered, [*POOL, "scope"], 3, (30,), False).select("anchor.*", "id", "km")
        found = found.withColumn("tier", F.when(F.col("scope") == ANY, 5).otherwise(4)).drop("scope")
        seeds = far.select(*STEP, "seed").distinct()
        named = spots.filter((F.col("r") == ANY) & (F.col("m") == ANY)).select("id", "area", "region", F.col("lat_r").alias("lat"), F.col("lng_r").alias("lng"))
        nearby = found.join(seeds, STEP).join(named, "id")
        hashed = F.struct("tier", draw(F.col("seed"), F.col("id")).alias("h"), *PLACE, "km")
        more = nearby.groupBy(*STEP).agg(F.min(hashed).alias("x")).select(*STEP, "x.tier", *(f"x.{c}" for c in PLACE), "x.km")
        best = cut(best.join(more.select(*STEP), STEP, "left_anti").union(more))
    shown = F.when(F.col("tier") <= 3, F.col("tier")).when(F.col("tier") <= 5, 4).otherwise(LAST_TIER)
    return best.withColumn("tier", shown)


def assemble(requests: DataFrame, places: DataFrame) -> DataFrame:
    """STEP, tier, PLACE and km of every requested step; the place is null without candidates.

    requests: request_id, seed, pos, slot, regions (empty is any) and mood (null is any). The anchor
    is drawn in the step with the fewest candidates and has tier 0. The others are chosen around it;
    a lodging step whose anchor has no coordinates goes by the first other step that has some.
    """
    pools = rank_pools(places)
    asked = cut(asked_pools(requests, pools.sizes))
    anchor_at = smallest_pools(asked).select(*STEP)
    anchors = cut(drawn_place(asked.join(anchor_at, STEP, "left_semi"), pools.places, "at", POOL))
    around = anchors.select("request_id", F.col("lat"), F.col("lng"), F.col("area").alias("anchor_area"), F.col("region").alias("anchor_region"))
    others = asked.join(anchor_at, STEP, "left_anti").join(around, "request_id")
    chosen = choose_near(others.filter("slot <> 'stay'"), pools)
    located = anchors.select("request_id", F.lit(-1).alias("pos"), "lat", "lng").union(chosen.select("request_id", "pos", "lat", "lng")).filter("lat is not null and lng is not null")
    first = located.groupBy("request_id").agg(F.min(F.struct("pos", "lat", "lng")).alias("x")).select("request_id", "x.lat", "x.lng")
    lodging = choose_near(others.filter("slot = 'stay'").drop("lat", "lng").join(first, "request_id", "left"), pools)
    columns = [*STEP, "tier", *PLACE, "km"]
    picked = chosen.select(columns).union(lodging.select(columns)).union(anchors.withColumn("tier", F.lit(0)).withColumn("km", F.lit(0.0)).select(columns))
    return requests.select(*STEP).join(picked, STEP, "left")


def legs(steps: DataFrame) -> DataFrame:
    """Each step with a place and the next one's: request_id, pos, id, next_id, km, mode, amount; the last has none."""
    order = Window.partitionBy("request_id").orderBy("pos")
    ahead = steps.filter("id is not null").select("request_id", "pos", "slot", "id", "lat", "lng", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("id", "lat", "lng")))
    km = haversine_km(F.col("lat"), F.col("lng"), F.col("next_lat"), F.col("next_lng"))
    return ahead.withColumn("km", km).withColumn("t", travel(F.col("km"))).select("request_id", "pos", "slot", "id", "next_id", "km", "t.mode", "t.amount")


def nearby_pool_on_grid(anchors: DataFrame, others: DataFrame, on: list[str], km: float = 10, enough: int = 12, fill: int = 25, least: int = 10) -> DataFrame:
    """anchor and id: others within km if there are `enough` of them, else the `fill` nearest.

    Anchors with under `least` located others of equal `on` get all of those. anchors and others as
    in nearest_on_grid; an anchor's numbers come from counts of points, and pairs are made last and
    not shuffled.
    """
    located = others.filter("lat_r is not null and lng_r is not null")
    here, point = F.col("lat").isNotNull() & F.col("lng").isNotNull(), [*on, "lat", "lng"]
    points = located.groupBy(*on, "lat_r", "lng_r").agg(F.count("*").alias("n"))
    sizes = points.groupBy(*on).agg(F.sum("n").alias("n"))
    own = located.select(F.col("id").alias("anchor"), *on, F.col("lat_r").alias("own_lat"), F.col("lng_r").alias("own_lng"))
    from_own = haversine_km(F.col("lat"), F.col("lng"), F.col("own_lat"), F.col("own_lng"))
    near = within_km(anchors.filter(here).select(*point).distinct(), points, km, on).groupBy(*point).agg(F.sum("n").alias("near"))
    counted = anchors.join(sizes, on, "left").join(own.hint("merge"), ["anchor", *on], "left").join(near.hint("merge"), point, "left")
    there = F.when(here, F.coalesce("n", F.lit(0)) - F.when(F.col("own_lat").isNotNull(), 1).otherwise(0)).otherwise(0)
    close = F.coalesce("near", F.lit(0)) - F.when(from_own <= km, 1).otherwise(0)
    sized = cut(counted.select("anchor", *point, there.alias("located"), close.alias("near")))
    many = sized.filter(F.col("located") >= least)
    full = many.filter(F.col("near") >= enough).withColumnRenamed("anchor", "id")
    within = pairs_within_km(full, located.withColumnRenamed("id", "id_r"), km, on).select(F.col("id").alias("anchor"), F.col("id_r").alias("id"))
    filled = nearest_on_grid(many.filter(F.col("near") < enough), located, on, fill, (km, 4 * km)).select("anchor", "id")
    return everyone(sized.filter(F.col("located") < least), others, on).union(within).union(filled).filter("anchor <> id")


def everyone(anchors: DataFrame, others: DataFrame, on: list[str], parts: int = 16) -> DataFrame:
    """anchor and id of all pairs of equal `on`: dealt to parts on both sides, so that a part of the anchors meets a part of the others."""
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    asked = gathered(anchors.select("anchor", *on).withColumn("__a", part("anchor")), [*on, "__a"], "anchor", "anchors", SHORT)
    offered = gathered(others.select("id", *on).withColumn("__o", part("id")), [*on, "__o"], "id", "ids")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    keys = [*on, "__a", "__o"]
    met = asked.withColumn("__o", every).join(offered.withColumn("__a", every).repartition(shuffles(others), *keys).hint("merge"), keys)
    return met.select(F.explode("anchors").alias("anchor"), "ids").select("anchor", F.explode("ids").alias("id"))


def encode_link(steps: DataFrame) -> DataFrame:
    """request_id and link: the ids of its steps in order, joined by dots."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"].cast("string"))
    return steps.filter("id is not null").groupBy("request_id").agg(F.array_join(ordered, ".").alias("link"))


def decode_link(links: DataFrame) -> DataFrame:
    """request_id, pos (from 0), id of links made of positive integers and dots; others give no rows."""
    parts = F.when(F.col("link").rlike(r"^[0-9]+(\.[0-9]+)*$"), F.split("link", r"\."))
    rows = links.select("request_id", F.posexplode(parts).alias("pos", "part"))
    return rows.select("request_id", "pos", F.expr("try_cast(part as bigint)").alias("id")).filter("id > 0")


def shared_steps(links: DataFrame, places: DataFrame, slot_order: list[str]) -> DataFrame:
    """The decoded steps with a known place, in slot order and then as given."""
    place = F.array_position(F.array(*map(F.lit, slot_order)), F.col("slot"))
    order = Window.partitionBy("request_id").orderBy(place, "pos")
    return decode_link(links).join(places.select("id", "name", "slot"), "id").select("request_id", (F.row_number().over(order) - 1).alias("step"), "id", "slot", "name")


def as_text(steps: DataFrame) -> DataFrame:
    """request_id and its steps as lines."""
    line = F.concat_ws(" ", F.concat((F.col("pos") + 1).cast("string"), F.lit(".")), F.col("slot"), F.coalesce(F.col("id").cast("string"), F.lit("-")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda s: s["line"])
    return steps.groupBy("request_id").agg(F.array_join(lines, "\n").alias("text"))
