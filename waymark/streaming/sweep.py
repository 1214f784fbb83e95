"""The rate limiter as a stateful operator whose idle keys are swept."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from waymark.streaming.rate import LIMITS, OUT, admit

#: The store that this operator's state needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """A key's admitted times; they go when the key has been idle for `idle_ms` of processing time.

    The store drops the value by its time to live; the timer, put off by every request, takes the
    key away even if nothing reads it again.
    """

    def __init__(self, limits: list[tuple[int, int, str]], idle_ms: int):
        self.limits, self.idle_ms = limits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getValueState("log", "times array<long>", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.log.get() if self.log.exists() else None
        log = deque(known[0]) if known else deque()
        asked = sorted((int(us), int(id_), ts) for batch in rows for us, id_, ts in zip(batch["us"], batch["id"], batch["ts"], strict=True))
        out = []
        for us, id_, ts in asked:
            ok, scope, wait = admit(log, us, self.limits)
            out.append((str(key[0]), id_, ts, ok, scope, wait // 1000))
        self.log.update((list(log),))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["key", "id", "ts", "admitted", "scope", "retry_after_ms"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.log.clear()
        yield from ()

    def close(self) -> None:
        pass


def swept_admission(requests: DataFrame, limits: list[tuple[int, int, str]] = LIMITS, idle_ms: int | None = None) -> DataFrame:
    """The verdicts of admission() over a stream of requests (key, id, ts); idle keys lose their state.

    A key is idle, by default, after the longest span of the limits, when nothing it remembers can
    refuse a request any more. A key's requests come in order of time from batch to batch.
    """
    idle = max(span for _, span, _ in limits) // 1000 if idle_ms is None else idle_ms
    rows = requests.select(F.col("key").cast("string"), F.col("id").cast("long"), "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("key").transformWithStateInPandas(Limiter(limits, idle), OUT, "append", "processingTime")
