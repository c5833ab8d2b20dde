"""Watching tables that keep growing: volumes against a season's usual ones, and keys that fall silent.

The same functions serve batch tables; a stream that is replayed gives the batch's answer, also over restarts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def season_of(start: Column) -> Column:
    """The hour of the day, the season of an hourly volume."""
    return F.hour(start)


def volumes(events: DataFrame, by: str, time: str = "ts", width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """``by``, window_start, n of all windows that have events; a stream gives each once, when ``delay`` has passed."""
    timed = events.select(F.col(by), F.col(time).cast("timestamp").alias("time_"))
    if timed.isStreaming:
        timed = timed.withWatermark("time_", delay)
    counted = timed.groupBy(by, F.window("time_", width)).agg(F.count("*").alias("n"))
    return counted.select(by, F.col("window.start").alias("window_start"), "n")


def seasonal_baseline(history: DataFrame, by: str, time: str = "ts", width: str = "1 hour") -> DataFrame:
    """``by``, season, usual: the mean volume of the windows of each season."""
    counted = volumes(history, by, time, width).withColumn("season", season_of(F.col("window_start")))
    return counted.groupBy(by, "season").agg(F.avg("n").alias("usual"))


def volume_alerts(events: DataFrame, baseline: DataFrame, by: str, time: str = "ts", width: str = "1 hour", threshold: float = 0.3, delay: str = "2 hours") -> DataFrame:
    """``by``, window_start, n, usual, deviation of the windows that deviate from their season by more than a share ``threshold``.

    A key or season that the baseline does not know deviates by 1.
    """
    counted = volumes(events, by, time, width, delay).withColumn("season", season_of(F.col("window_start")))
    known = baseline.select(F.col(by).alias("by_"), F.col("season").alias("season_"), "usual")
    both = counted.join(known, F.col(by).eqNullSafe(F.col("by_")) & (F.col("season") == F.col("season_")), "left")
    deviation = F.coalesce(F.abs(F.col("n") - F.col("usual")) / F.col("usual"), F.lit(1.0))
    return both.withColumn("deviation", F.round(deviation, 4)).where(deviation > threshold).select(by, "window_start", "n", "usual", "deviation")


class Silence(StatefulProcessor):
    """Tells once of each time that a key had no event for longer than ``most`` milliseconds.

    Events wait until the watermark has passed them, so their order does not matter; a timer ends the
    silence's wait where no event comes.
    """

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, told boolean")
        self.waiting = handle.getListState("waiting", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        return self.settled(key, [row.at_ for row in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self.settled(key, [], timerValues.getCurrentWatermarkInMs())

    def settled(self, key, new: list[int], passed: int) -> Iterator[Row]:
        last, told = self.last.get() if self.last.exists() else (None, False)
        times = sorted([*(row[0] for row in (self.waiting.get() if self.waiting.exists() else ())), *new])
        out = []
        for at in [t for t in times if t <= passed]:
            if last is not None and at - last > self.most and not told:
                out.append(Row(key=key[0], since=last))
            if last is None or at > last:
                last, told = at, False
        later = [t for t in times if t > passed]
        if last is not None and not told and passed - last > self.most:
            out.append(Row(key=key[0], since=last))
            told = True
        if last is not None:
            self.last.update((last, told))
        if later:
            self.waiting.put([(t,) for t in later])
            self.handle.registerTimer(later[0])
        else:
            self.waiting.clear()
        if last is not None and not told:
            self.handle.registerTimer(last + self.most + 1)
        return iter(out)

    def close(self) -> None:
        pass


def silences(events: DataFrame, by: str, most_seconds: int, time: str = "ts", delay: str = "2 hours") -> DataFrame:
    """key, since: every time that a key had no event for longer than ``most_seconds``, from its last one before.

    Time counts up to the latest event less ``delay``, as far as a stream has settled it.
    Rows without a key or a time are left out; times count in whole milliseconds.
    """
    rows = events.select(F.col(by).alias("key"), F.col(time).cast("timestamp").alias("time_")).where("key IS NOT NULL AND time_ IS NOT NULL")
    at, most = F.unix_millis("time_"), 1000 * most_seconds
    kind = rows.schema["key"].dataType
    if rows.isStreaming:
        rows = rows.withWatermark("time_", delay).select("key", "time_", at.alias("at_"))
        schema = T.StructType([T.StructField("key", kind), T.StructField("since", T.LongType())])
        found = rows.groupBy("key").transformWithState(Silence(most), schema, "Append", "EventTime")
    else:
        end = rows.agg((F.unix_millis(F.max("time_") - F.expr(f"INTERVAL {delay}"))).alias("end_"))  # one row
        after = F.lead("at_").over(Window.partitionBy("key").orderBy("at_"))
        timed = rows.select("key", at.alias("at_")).withColumn("next_", after).join(F.broadcast(end))
        found = timed.where(F.least("next_", "end_") - F.col("at_") > most).select("key", F.col("at_").alias("since"))
    return found.select("key", F.timestamp_millis("since").alias("since"))


def append_once(rows: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Start a query that writes each batch of ``rows`` below ``path`` once: a batch that is repeated after a failure replaces itself.

    With ``every`` (such as "5 minutes") it goes on, else it ends with the data at hand.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
