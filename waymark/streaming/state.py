"""Closure and processed-item history as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def closure_stream(events: DataFrame, limit: int = 3) -> DataFrame:
    """key, fails, closed, n after each micro-batch for the keys in it; a closed key stays so.

    events: key, ts, id, found; a key's events arrive in order from batch to batch.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fails, closed, n = state.get if state.exists else (0, False, 0)
        seen = sorted((ts, id_, found) for batch in batches for ts, id_, found in zip(batch["ts"], batch["id"], batch["found"], strict=True))  # one key's of one micro-batch
        for _, _, found in seen:
            if closed:
                break
            fails, n = 0 if found else fails + 1, n + 1
            closed = fails >= limit
        state.update((fails, closed, n))
        yield pd.DataFrame([(key[0], fails, closed, n)], columns=["key", "fails", "closed", "n"])

    rows = events.select(F.col("key").cast("long"), "ts", F.col("id").cast("long"), "found")
    return rows.groupBy("key").applyInPandasWithState(run, "key long, fails long, closed boolean, n long", "fails long, closed boolean, n long", "update", GroupStateTimeout.NoTimeout)


def unseen(items: DataFrame, key: str, ts: str, forget: str = "7 days") -> DataFrame:
    """Items whose key has not come before within the time that state is kept."""
    return items.withWatermark(ts, forget).dropDuplicatesWithinWatermark([key])


def once_a_day(ticks: DataFrame, ts: str, hour: int, forget: str = "2 days") -> DataFrame:
    """The first tick of each day in the given hour."""
    due = ticks.filter(F.hour(ts) == hour).withColumn("day", F.to_date(ts))
    return due.withWatermark(ts, forget).dropDuplicatesWithinWatermark(["day"])
