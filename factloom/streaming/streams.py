"""The store's logs as streams: windows, sessions, expiry by timers and a usage guard. A lexical index follows a stream by postings.PostingIndex.keep.

The batch engine is the reference for each: a stream over the same rows ends with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def read(spark: SparkSession, path: str, schema, time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """A stream over the Parquet files of a folder; `time` gets a zone and a watermark."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if time else rows


def windowed(events: DataFrame, time: str, length: str, slide: str | None = None, by: str = "action") -> DataFrame:
    """Counts of tumbling or sliding windows."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return events.groupBy(window.alias("window"), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, time: str, gap: str, by: str) -> DataFrame:
    """Counts of sessions that a gap ends."""
    return events.groupBy(F.session_window(time, gap).alias("session"), by).agg(F.count("*").alias("n")).select(by, F.col("session.start").alias("start"), "n")


def last_state(events: DataFrame, key: str = "memory_id", time: str = "ts", action: str = "action") -> DataFrame:
    """Each key's latest action so far, updated with every batch."""
    return events.groupBy(key).agg(F.max_by(action, F.struct(time)).alias(action), F.max(time).alias(time))


class Expiry(StatefulProcessor):
    """Holds a memory's last record and a timer for the end of its life; a later record moves the timer or takes it away."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "changed_ms long, until_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        was = self.last.get() if self.last.exists() else None
        best = was
        for frame in rows:
            for changed, until in zip(frame.changed_ms.tolist(), frame.until_ms.tolist(), strict=True):
                until = -1 if pd.isna(until) else int(until)
                if best is None or (int(changed), until) > (best[0], best[1]):
                    best = (int(changed), until)
        if best is None or best == was:
            return
        if was is not None and was[1] >= 0:
            self.handle.deleteTimer(was[1])
        self.last.update(best)
        if 0 <= best[1] <= timerValues.getCurrentWatermarkInMs():
            yield self._told(key, best[1])
        elif best[1] >= 0:
            self.handle.registerTimer(best[1])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The record stays, so that what comes late does not bring the memory back.
        yield self._told(key, expiredTimerInfo.getExpiryTimeInMs())

    def _told(self, key: tuple, until: int) -> pd.DataFrame:
        return pd.DataFrame({"memory_id": [key[0]], "expired_at": [pd.Timestamp(until, unit="ms")]})

    def close(self) -> None:
        pass


def expiring(memories: DataFrame, key: str = "memory_id", created: str = "created_at", ttl: str = "ttl_seconds", changed: str = "changed_at") -> DataFrame:
    """(memory_id, expired_at) once the watermark passes the end of a memory's life, created + ttl.

    memories: a stream of records with a watermark on `changed`; of several records of a memory the last changed one holds, a
    null ttl is endless life, and a record that comes after a later one changes nothing. Rows behind the watermark are dropped
    by the stream; those whose end has passed already are told at once. Needs the RocksDB state store.
    """
    memories.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = memories.select(F.col(key).cast("long").alias(key), changed, F.unix_millis(changed).alias("changed_ms"), (F.unix_millis(created) + F.col(ttl) * 1000).cast("long").alias("until_ms"))
    return own.groupBy(key).transformWithStateInPandas(Expiry(), "memory_id long, expired_at timestamp", "Append", "EventTime")


def usage_guard(runs: DataFrame, share: float = 1.3) -> DataFrame:
    """Running totals of each task's arms, and whether the target is beyond `share` times the larger peer."""
    arm = lambda p: F.sum(F.when(F.col("arm") == p, F.col("tokens"))).alias(p)
    out = runs.groupBy("task_id").agg(arm("target"), arm("left"), arm("right"))
    return out.withColumn("over", F.coalesce(F.col("target") > share * F.greatest("left", "right"), F.lit(False)) & F.col("left").isNotNull() & F.col("right").isNotNull())


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that is there now, through a memory table: for tests and small reports."""
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)
