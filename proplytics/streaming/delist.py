"""Delisting as a stream: state and an event-time timer for every listing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = dt.datetime(1970, 1, 1)
EVENTS = "source string, listing_id string, event string, run_day date, last_seen date"


class Absence(StatefulProcessor):
    """Last sighting of a listing and whether it counts as gone; the timer is due when the run after the last allowed one begins."""

    def __init__(self, missed: int, every: dt.timedelta):
        self.missed, self.every = missed, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("absence", "last_seen date, gone boolean")

    def _timer(self, last: dt.date) -> int:
        due = dt.datetime.combine(last, dt.time()) + self.missed * self.every
        return int((due - EPOCH).total_seconds() * 1000) + 1

    def _gone(self, key, last: dt.date) -> Row:
        return Row(source=key[0], listing_id=key[1], event="delisted", run_day=last + self.missed * self.every, last_seen=last)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, gone = self.state.get() if self.state.exists() else (None, False)
        before = last
        for day in sorted({r["run_day"] for r in rows}):
            if last is not None and day <= last:
                continue
            # a gap that ends within this batch: its timer has not come up yet
            if last is not None and not gone and day - last > self.missed * self.every:
                yield self._gone(key, last)
                gone = True
            if gone:
                yield Row(source=key[0], listing_id=key[1], event="relisted", run_day=day, last_seen=last)
            last, gone = day, False
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            self.handle.registerTimer(self._timer(last))
            self.state.update((last, gone))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, gone = self.state.get()
        if not gone:
            self.state.update((last, True))
            yield self._gone(key, last)

    def close(self) -> None:
        pass


def delisting_stream(sightings: DataFrame, missed: int = 3, every: dt.timedelta = dt.timedelta(days=1), delay: str = "0 seconds") -> DataFrame:
    """Events of ``history.delistings`` for sources that are crawled ``every`` day, from a stream of (source, listing_id, run_day).

    State is one row and one timer a listing. Sightings of a day may come in any order until a later day moves the watermark past them;
    ``delay`` lets it wait longer.
    """
    timed = sightings.dropna(subset=["source", "listing_id", "run_day"]).withColumn("run_at", F.col("run_day").cast("timestamp")).withWatermark("run_at", delay)
    return timed.groupBy("source", "listing_id").transformWithState(Absence(missed, every), EVENTS, "Append", "EventTime")


def run_delisting(sightings: DataFrame, path: str, **options) -> DataFrame:
    """Drain the stream into ``path`` and read its events; timers need the RocksDB state store, which is set for this query alone."""
    spark = sightings.sparkSession
    held = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = delisting_stream(sightings, **options).writeStream.format("parquet").outputMode("append")
        writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/events").awaitTermination()
    finally:
        if held is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, held)
    return spark.read.schema(EVENTS).parquet(f"{path}/events")
