"""The crawl frontier as keyed state of a stream: least scores, one pop an entry, and expiry by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

POPPED = "url string, score double, popped_at timestamp"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Entries(StatefulProcessor):
    """One url's entry: waiting with its least score until it is due, then visited until it expires (`keep_ms`; None: for good).

    A candidate that comes while the entry waits lowers its score and may bring it forward; one that comes while it is
    visited is left out; a later one makes a new entry. A timer pops the entry when the watermark reaches its time; a candidate of a
    later time pops it at once, so what is popped does not depend on when timers fire. Expired entries are cleared.
    """

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # until is -1 while the entry waits
        self.entry = handle.getValueState("entry", "score double, due long, until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = now = self.entry.get()  # None without an entry; each call is a round trip to the JVM
        for at, score, due in sorted((r.at_ms, r.score, r.due_ms) for r in rows):
            if now and now[2] < 0 and at > now[1]:
                yield self._popped(key, now)
                now = self._visited(now)
            if now and now[2] >= 0 and (self.keep_ms is None or at <= now[2]):
                continue
            if now and now[2] < 0:
                now = (min(now[0], score), min(now[1], due), -1)
            else:
                now = (score, due, -1)
        if now != before:
            if before and (timer := self._timer(before)) is not None:
                self.handle.deleteTimer(timer)
            self._keep(now)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = self.entry.get()
        if now and self._timer(now) == expiredTimerInfo.getExpiryTimeInMs():
            if now[2] < 0:
                yield self._popped(key, now)
                self._keep(self._visited(now))
            else:
                self.entry.clear()

    def close(self) -> None:
        pass

    def _visited(self, now: tuple) -> tuple:
        return (now[0], now[1], now[1] + (self.keep_ms or 0))

    def _timer(self, now: tuple) -> int | None:
        return now[1] if now[2] < 0 else None if self.keep_ms is None else now[2]

    def _keep(self, now: tuple) -> None:
        self.entry.update(now)
        if (timer := self._timer(now)) is not None:
            self.handle.registerTimer(timer)

    @staticmethod
    def _popped(key, now: tuple) -> Row:
        return Row(url=key[0], score=now[0], due_ms=now[1])


@contextmanager
def rocks(spark: SparkSession):
    """Timers need the RocksDB state store; the session's own choice comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def frontier(candidates: DataFrame, ts: str = "ts", wait: Column | None = None, keep_hours: float | None = None, delay: str = "0 seconds") -> DataFrame:
    """Popped (url, score, popped_at) of a stream of candidates (url, score, `ts`).

    `wait` is the hours an entry waits after a candidate (its score, unless given): the lower it is, the sooner the url is popped, and a better
    candidate brings it forward. A popped url is not popped again for `keep_hours` (None: ever). State is one small row a
    url, dealt by url; nothing of it is rewritten but the rows of the urls at hand. Rows without url, score or time are left
    out; candidates later than the watermark (`delay`) are dropped by Spark. Start the result with rocks().
    """
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    hours = F.greatest(F.coalesce(wait if wait is not None else F.col("score"), F.lit(0.0)), F.lit(0.0))
    rows = candidates.filter(F.col("url").isNotNull() & F.col("score").isNotNull() & F.col(ts).isNotNull()).withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", delay)
    rows = rows.select("url", F.col("score").cast("double").alias("score"), "_at", ms.alias("at_ms"), (ms + (hours * 3_600_000).cast("long")).alias("due_ms"))
    keep = None if keep_hours is None else int(keep_hours * 3_600_000)
    popped = rows.groupBy("url").transformWithState(Entries(keep), "url string, score double, due_ms long", "Append", "EventTime")
    return popped.select("url", "score", F.timestamp_millis("due_ms").alias("popped_at"))


def run(popped: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what is popped to the folder `out` until the input at hand is done; a restart goes on from the checkpoint."""
    with rocks(popped.sparkSession):
        return popped.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
