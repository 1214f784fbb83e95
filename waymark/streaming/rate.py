"""Admission by a sliding log: the same function serves a batch replay and a stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: (requests, microseconds, scope): so many at most in less than that time.
LIMITS = [(25, 60_000_000, "minute"), (250, 3_600_000_000, "hour")]


def admit(log: deque[int], now: int, limits: list[tuple[int, int, str]] = LIMITS) -> tuple[bool, str | None, int]:
    """(admitted, the scope that refuses, microseconds to wait). The log holds admitted times, oldest first; refused ones aren't kept."""
    longest = max(span for _, span, _ in limits)
    while log and now - log[0] >= longest:
        log.popleft()
    for most, span, scope in limits:
        # the log has `most` entries of the span only if its most-th last is one
        if len(log) >= most and now - log[-most] < span:
            return False, scope, span - (now - log[-most])
    log.append(now)
    return True, None, 0


OUT = "key string, id long, ts timestamp, admitted boolean, scope string, retry_after_ms long"


def admission(requests: DataFrame, limits: list[tuple[int, int, str]] = LIMITS) -> DataFrame:
    """The verdict of every request (key, id, ts), by key in order of ts and id.

    Keys are dealt to partitions and sorted there by Spark; a task streams through its rows and
    holds one key's log, so that no group has to fit in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, log = None, deque()
        for batch in batches:
            rows = []
            for key, id_, ts, us in batch.itertuples(index=False):
                if key != last:
                    last, log = key, deque()
                ok, scope, wait = admit(log, us, limits)
                rows.append((key, id_, ts, ok, scope, wait // 1000))
            yield pd.DataFrame(rows, columns=["key", "id", "ts", "admitted", "scope", "retry_after_ms"])

    dealt = requests.select(F.col("key").cast("string"), F.col("id").cast("long"), "ts", F.unix_micros("ts").alias("us")).repartition("key").sortWithinPartitions("key", "us", "id")
    return dealt.mapInPandas(run, OUT)


def admission_stream(requests: DataFrame, limits: list[tuple[int, int, str]] = LIMITS, late: str = "1 hour") -> DataFrame:
    """The same over a stream; a key's state goes when the watermark has passed all it remembers."""
    longest = max(span for _, span, _ in limits)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0]) if state.exists else deque()
        asked = sorted((int(us), int(id_), ts) for batch in batches for us, id_, ts in zip(batch["us"], batch["id"], batch["ts"], strict=True))  # one key's of one micro-batch
        out = []
        for us, id_, ts in asked:
            ok, scope, wait = admit(log, us, limits)
            out.append((key[0], id_, ts, ok, scope, wait // 1000))
        state.update((list(log),))
        state.setTimeoutTimestamp(max((log[-1] + longest) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "id", "ts", "admitted", "scope", "retry_after_ms"])

    rows = requests.withWatermark("ts", late).select(F.col("key").cast("string"), F.col("id").cast("long"), "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("key").applyInPandasWithState(run, OUT, "log array<long>", "append", GroupStateTimeout.EventTimeTimeout)
