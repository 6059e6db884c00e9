"""The life of work items as a stream: the latest status of each, and those that stay unfinished for too long.

Each item keeps its last event and a timer in event time. When the watermark passes the timer of an unfinished item, the item
is stale; an event that comes later makes it current again. What changes goes to a table by upserts, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..sources.buckets import BucketTable

_STORE = "spark.sql.streaming.stateStore.providerClass"


class _Life(StatefulProcessor):
    """State: the last event's time (microseconds), its id and status."""

    def __init__(self, key: str, hours: float, done: str):
        self.key, self.wait, self.done = key, int(hours * 3600 * 1000), done

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, id long, status string")

    def _row(self, key, ts, id, status, stale):
        return pd.DataFrame({self.key: [key[0]], "status": [status], "us": [ts], "event_id": [id], "stale": [stale]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = old = self.last.get() if self.last.exists() else None
        for part in rows:
            for ts, id, status in zip(part["us"].tolist(), part["event_id"].tolist(), part["status"].tolist(), strict=True):
                if best is None or (ts, id) > (best[0], best[1]):
                    best = (ts, id, status)
        if best is not None and best is not old:
            self.last.update(best)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if best[2] != self.done:
                self.handle.registerTimer(best[0] // 1000 + self.wait + 1)
            yield self._row(key, *best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ts, id, status = self.last.get()
        yield self._row(key, ts, id, status, True)

    def close(self) -> None:
        pass


def life_changes(events: DataFrame, key: str = "user_id", hours: float = 2, done: str = "completed", late: str = "1 day") -> DataFrame:
    """Changes of items (key, status, ts, event_id, stale) from a stream of events (key, ts, event_id, status).

    The last event by (ts, event_id) counts, in whatever order events come, if they are not later than `late`. Unfinished items
    are stale when the watermark, which is `late` behind the last event seen, is `hours` past their last event.
    """
    kind = events.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("status", T.StringType()), T.StructField("us", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("stale", T.BooleanType())])
    ts = F.col("ts").cast("timestamp")
    own = events.select(key, ts.alias("ts"), F.unix_micros(ts).alias("us"), F.col("event_id").cast("long").alias("event_id"), "status").withWatermark("ts", late)
    changes = own.groupBy(key).transformWithStateInPandas(_Life(key, hours, done), schema, "Update", "EventTime")
    return changes.select(key, "status", F.timestamp_micros("us").alias("ts"), "event_id", "stale")


def run_status(events: DataFrame, checkpoint: str, path: str, key: str = "user_id", buckets: int = 64, **how) -> tuple[StreamingQuery, BucketTable]:
    """Runs over all that is there, then ends; the table holds each item's latest change."""
    spark = events.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # timers need it
    try:
        changes = life_changes(events, key, **how)
        table = BucketTable(spark, path, changes.schema, [key], ["ts", "event_id", "stale"], buckets)
        query = changes.writeStream.foreachBatch(lambda batch, no: table.apply(batch, no) and None).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)
    return query, table
