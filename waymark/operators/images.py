"""Pictures for the steps of a course, none twice while others are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable_url(url: Column, blocked: list[str], shortest: int = 10) -> Column:
    """A web address of some length on none of the blocked hosts."""
    good = F.startswith(F.trim(url), F.lit("http")) & (F.length(F.trim(url)) >= shortest)
    for host in blocked:
        good = good & ~F.contains(url, F.lit(host))
    return F.coalesce(good, F.lit(False))


def course_images(steps: DataFrame, by: list[str], pools: dict[str, list[str]], default: str, blocked: list[str]) -> DataFrame:
    """by, pos, id and image of every step: a fold over a course's steps in their order.

    steps: by, pos, id, url and pool (the name of a pool; unknown and null ones are the default). A
    step takes its own url if that is usable and not taken before it; else the pool's pictures are
    tried in turn from place id modulo their number on; if all are taken, the first tried is used
    again. A course's steps are few, and meet in one row.
    """
    lists = F.create_map(*(x for name, urls in pools.items() for x in (F.lit(name), F.array(*map(F.lit, urls)))))
    pool = F.coalesce(F.try_element_at(lists, "pool"), F.array(*map(F.lit, pools[default])))
    own = F.when(usable_url(F.col("url"), blocked), F.trim("url"))
    at = F.abs(F.coalesce("id", F.lit(0))) % F.size(pool)
    turned = F.concat(F.slice(pool, at.cast("int") + 1, F.size(pool)), F.slice(pool, F.lit(1), at.cast("int")))
    rows = steps.select(*by, F.struct("pos", "id", own.alias("own"), turned.alias("tried")).alias("step"))
    ordered = rows.groupBy(*by).agg(F.sort_array(F.collect_list("step")).alias("steps"))

    def choose(taken: Column, step: Column) -> Column:
        free = F.filter(step["tried"], lambda u: ~F.array_contains(taken, u))
        own_free = step["own"].isNotNull() & ~F.array_contains(taken, F.coalesce(step["own"], F.lit("")))
        return F.when(own_free, step["own"]).otherwise(F.coalesce(F.get(free, 0), F.get(step["tried"], 0)))

    none = F.array().cast("array<string>")
    taken = F.aggregate("steps", none, lambda acc, step: F.concat(acc, F.array(choose(acc, step))))
    placed = ordered.select(*by, F.posexplode(F.arrays_zip(F.col("steps").alias("step"), taken.alias("image"))).alias("k", "x"))
    return placed.select(*by, "x.step.pos", "x.step.id", "x.image")
