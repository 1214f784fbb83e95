"""Queues, samples, closure and recent lists over event histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stalest(df: DataFrame, age: str | Column, n: int, key: str = "id") -> DataFrame:
    """The n rows with the smallest age, null first, by key on ties."""
    return df.orderBy((F.col(age) if isinstance(age, str) else age).asc_nulls_first(), key).limit(n)


def stride_sample(df: DataFrame, key: str, first: int = 1000, wanted: int = 100) -> DataFrame:
    """Of the first rows by key every max(1, n // wanted)-th, at most `wanted`."""
    head = df.orderBy(key).limit(first).withColumn("__k", F.row_number().over(Window.orderBy(key)) - 1)
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / wanted))
    marked = head.join(F.broadcast(head.agg(F.count("*").alias("__n"))))
    return marked.filter((F.col("__k") % step == 0) & (F.col("__k") / step < wanted)).drop("__k", "__n")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows (all if fewer), the same for the same seed however rows are partitioned."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), key).limit(n)


def closure(events: DataFrame, limit: int = 3) -> DataFrame:
    """key, fails (misses since the last hit), closed (limit misses in a row, once and for all), n, last_ts.

    events: key, ts, id (order among equal ts), found. Each miss counts the misses after the last
    hit before it; checks after a closure do not count.
    """
    w = Window.partitionBy("key").orderBy("ts", "id")
    run = F.count_if("found").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fails = F.count_if(~F.col("found")).over(Window.partitionBy("key", "run").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = events.withColumn("run", run).withColumn("fails", fails)
    closed_at = F.min(F.when(F.col("fails") >= limit, F.struct("ts", "id")))
    ends = marked.groupBy("key").agg(closed_at.alias("closed_at"))
    live = marked.join(ends, "key").filter("closed_at is null or struct(ts, id) <= closed_at")
    return live.groupBy("key").agg(F.max_by("fails", F.struct("ts", "id")).alias("fails"), F.max(F.col("closed_at").isNotNull()).alias("closed"), F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def recent(events: DataFrame, key: str, item: str, ts: str, n: int = 100) -> DataFrame:
    """The last n different items of each key, newest first (rank from 1)."""
    last = events.groupBy(key, item).agg(F.max(ts).alias(ts))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), item))
    return last.withColumn("rank", rank).filter(F.col("rank") <= n)


def trim_cache(entries: DataFrame, ts: str, most: int = 1000, keep: int = 800) -> DataFrame:
    """All entries, or the newest `keep` if there are more than `most`."""
    total = entries.agg(F.count("*").alias("__n"))
    ranked = entries.orderBy(F.desc(ts), "key").limit(most + 1).withColumn("__k", F.row_number().over(Window.orderBy(F.desc(ts), "key")))
    return ranked.join(F.broadcast(total)).filter((F.col("__n") <= most) | (F.col("__k") <= keep)).drop("__n", "__k")


def offered_load(requests: DataFrame, seconds: int) -> DataFrame:
    """Each request with how many of its key fell in the seconds up to it (itself included).

    A key is cut into buckets of that many seconds, each with a copy of the one before as context.
    """
    span = seconds * 1_000_000
    at = F.unix_micros("ts")
    own = ((at - F.pmod(at, F.lit(span))) / span).cast("long")
    copies = F.when(at.isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    dealt = requests.withColumn("__b", own).withColumn("__next", F.explode(copies)).withColumn("__b", F.col("__b") + F.col("__next"))
    w = Window.partitionBy("key", "__b").orderBy(at).rangeBetween(-span + 1, 0)
    return dealt.withColumn("load", F.count("*").over(w)).filter("__next = 0").drop("__b", "__next")
