"""Monitors over streams; the same functions serve batch tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Events, summed value and users of each window and type; late rows beyond the watermark are left out of a stream.

    Event times without a zone are read in the session's zone.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", watermark)
    counted = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def deduplicated(events: DataFrame, keys: list[str], watermark: str = "2 hours") -> DataFrame:
    """The first event of each key; a stream forgets keys after the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def observe_stream(rows: DataFrame, name: str, baseline: DataFrame, path: str, checkpoint: str, now: str | None = None, every: str | None = None, callbacks: list[Callable] = ()):
    """Start a query that holds every batch against a stored baseline: its schema, and its freshness at the time of the batch (or at ``now``).

    A batch's volume says nothing of the whole table's: for volumes see :func:`migcheck.streaming.monitor.volume_alerts`.
    Alerts go to ``path``, a folder a batch, so that a batch that is repeated after a failure replaces its own,
    and to the callbacks.  With ``every`` (such as "5 minutes") it goes on, else it ends with the data at hand.
    """
    from migcheck.plans import observer

    def check(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            time = now or batch.sparkSession.sql("SELECT CAST(current_timestamp() AS STRING)").first()[0]
            findings = observer.observe({name: batch}, baseline, time, checks=("schema_drift", "freshness"))
            observer.dispatch(findings, f"{path}/batch={number}", callbacks, mode="overwrite")
        finally:
            batch.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return rows.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def watch(events: DataFrame, baseline_rows: int, path: str, checkpoint: str, threshold: float = 0.3):
    """Start a query that writes a volume check of every batch below ``path``, once each."""
    from migcheck.plans.monitor import volume_anomaly

    def check(batch: DataFrame, number: int) -> None:
        counted = batch.agg(F.count("*").alias("n_rows"))
        deviation, anomaly = volume_anomaly(F.col("n_rows"), F.lit(baseline_rows), threshold)
        counted.select("n_rows", deviation.alias("deviation"), anomaly.alias("is_anomaly")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
