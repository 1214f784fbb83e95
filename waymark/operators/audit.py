"""Statistics over places and courses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from waymark.session import cut


def status_totals(places: DataFrame, closed: Column, has_image: Column) -> DataFrame:
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return places.agg(F.count("*").alias("total"), yes(closed).alias("closed"), (F.count("*") - yes(closed)).alias("active"), yes(has_image).alias("with_image"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value, null included, and their share in percent."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(df.agg(F.count("*").alias("__all"))), how="inner").select("value", "n", F.round(F.try_divide(100.0 * F.col("n"), F.col("__all")), 4).alias("percent"))


def tag_distribution(df: DataFrame, tags: str) -> DataFrame:
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def candidate_cube(places: DataFrame) -> DataFrame:
    """Distinct places for each slot and every region and mood, ALL being any.

    A place's own regions and moods meet in one row of it, whose sets are then only counted.
    """
    mood = F.when(F.size("moods") > 0, F.col("moods")).otherwise(F.array(F.lit(None).cast("string")))
    every = lambda x: F.array(*(F.struct(r.alias("region"), m.alias("mood")) for r in (x["region"], F.lit("ALL")) for m in (x["mood"], F.lit("ALL"))))
    ids = places.select("id", "slot", "region", F.explode(mood).alias("mood")).groupBy("slot", "id").agg(F.collect_set(F.struct("region", "mood")).alias("own"))
    sets = ids.select("slot", "id", F.explode(F.array_distinct(F.flatten(F.transform("own", every)))).alias("x")).select("slot", "id", "x.*")
    return sets.filter("region is not null and mood is not null").groupBy("region", "mood", "slot").agg(F.count("id").alias("n"))


def fill_rates(steps: DataFrame, by: list[str]) -> DataFrame:
    """Steps, empty steps and the filled share of each group of each set of one column, and of all."""
    sets = steps.groupBy(*by).agg(F.count("*").alias("steps"), F.count_if(F.col("id").isNull()).alias("empty"))
    out = [sets.groupBy(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("member")).agg(F.sum("steps").alias("steps"), F.sum("empty").alias("empty")) for c in by]
    whole = sets.agg(F.sum("steps").alias("steps"), F.sum("empty").alias("empty")).select(F.lit("ALL").alias("dimension"), F.lit("ALL").alias("member"), "steps", "empty")
    for part in out:
        whole = whole.union(part)
    return whole.withColumn("filled", F.round(1 - F.try_divide(F.col("empty").cast("double"), F.col("steps")), 6))


def contamination(steps: DataFrame, wanted: str, got: str) -> DataFrame:
    """Of each wanted region: steps, steps elsewhere, and courses over several regions."""
    per_course = steps.filter(F.col(got).isNotNull()).groupBy("request_id", wanted).agg(F.count("*").alias("n"), F.count_if(F.col(got) != F.col(wanted)).alias("away"), F.count_distinct(got).alias("regions"))
    return per_course.groupBy(wanted).agg(F.sum("n").alias("steps"), F.sum("away").alias("elsewhere"), F.count_if(F.col("regions") > 1).alias("mixed_courses"))


def duplicates(steps: DataFrame) -> DataFrame:
    """Courses that hold a place twice."""
    return steps.filter("id is not null").groupBy("request_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("different")).filter("n > different")


def diversity(steps: DataFrame, by: list[str]) -> DataFrame:
    return steps.groupBy(*by).agg(F.count_distinct("id").alias("different"))


def beyond(hops: DataFrame, limits: list[float]) -> DataFrame:
    """How many hops are longer than each limit."""
    return hops.agg(F.count("km").alias("hops"), *(F.count_if(F.col("km") > x).alias(f"over_{x:g}") for x in limits))


def order_statistics(df: DataFrame, column: str, shares: dict[str, float], digits: int = 3) -> DataFrame:
    """For each name the value at place floor(n * share) of the sorted column, and n, mean and max.

    Values are rounded first and counted. Their counts are dealt out by ranges of the values; sums
    of the ranges say in which one a place lies, and only that range is walked through.
    """
    counts = df.select(F.round(column, digits).alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    dealt = cut(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("v")).alias("s"), F.max("v").alias("max"))  # a row a range
    total = parts.agg(F.sum("c").alias("n"), F.sum("s").alias("s"), F.max("max").alias("max"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select("part", "c", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("ahead"))
    wanted = total.select("n", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.floor(F.col("n") * p).alias("place")) for name, p in shares.items()))).alias("x")).select("x.*")
    lies = wanted.join(ahead, (F.col("place") >= F.col("ahead")) & (F.col("place") < F.col("ahead") + F.col("c"))).select("part", "ahead", "name", "place")
    within = Window.partitionBy("part", "name").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = dealt.join(F.broadcast(lies), "part").withColumn("upto", F.col("ahead") + F.sum("c").over(within))  # a row a share
    found = walked.filter("upto > place").groupBy("name").agg(F.min("v").alias("v"))
    at = [F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares]
    mean = F.round(F.try_divide(F.col("s"), F.col("n")), digits).alias("mean")
    return total.join(F.broadcast(found.agg(*at))).select("n", mean, *shares, "max")


def transitions(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rows of each change from old to new."""
    changed = ~F.col(old).eqNullSafe(F.col(new))
    return df.filter(changed).groupBy(F.col(old).alias("old"), F.col(new).alias("new")).agg(F.count("*").alias("n"))


def funnel(candidates: DataFrame, stages: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(candidates with outcome: the first stage they fail, else "kept"; rows of each outcome)."""
    outcome = F.lit("kept")
    for name, passes in reversed(stages):
        outcome = F.when(~F.coalesce(passes, F.lit(False)), name).otherwise(outcome)
    marked = candidates.withColumn("outcome", outcome)
    return marked, marked.groupBy("outcome").agg(F.count("*").alias("n"))


def observed_funnel(candidates: DataFrame, stages: list[tuple[str, Column]], name: str = "funnel") -> tuple[DataFrame, Observation]:
    """(the rows that pass every stage, what was counted while they were made).

    The observation gives `all`, `kept` and a number of rows for every stage that is the first they
    fail; it is filled by the one pass that writes or collects the rows, without further reads.
    """
    marked, _ = funnel(candidates, stages)
    seen = Observation(name)
    counted = marked.observe(seen, F.count("*").alias("all"), *(F.count_if(F.col("outcome") == s).alias(s) for s in [*(s for s, _ in stages), "kept"]))
    return counted.filter("outcome = 'kept'").drop("outcome"), seen


def pivot_slots(steps: DataFrame, slots: list[str]) -> DataFrame:
    """request_id and the place of each slot; the last step wins."""
    return steps.groupBy("request_id").agg(*(F.max_by(F.when(F.col("slot") == s, F.col("id")), F.when(F.col("slot") == s, F.col("pos"))).alias(s) for s in slots), (F.sum("id") % 10).alias("template"))
