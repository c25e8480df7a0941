"""Streams of the index and embedding queues (ST-1..ST-6, ST-8) and event-time windows (E-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _marked(df: DataFrame, time: str, delay: str) -> DataFrame:
    """With a watermark; streams want a timestamp with a zone for it, and batches have no late rows."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay) if df.isStreaming else df


def keyed_queue(requests: DataFrame, keys: list[str], time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """ST-1: a request for a key that is queued already is one with it, within the delay."""
    marked = _marked(requests, time, delay)
    return marked.dropDuplicatesWithinWatermark(keys) if requests.isStreaming else marked.dropDuplicates(keys)


def latest_status(events: DataFrame, keys: list[str], time: str = "ts", status: str = "status") -> DataFrame:
    """ST-2, ST-6: the last status of each key; batch and stream (complete or update mode) alike."""
    return events.groupBy(*keys).agg(F.max_by(status, F.struct(F.col(time), F.col(status))).alias("status"), F.max(time).alias("at"), F.count("*").alias("n"))


def without_cancelled(work: DataFrame, cancelled: DataFrame, keys: list[str]) -> DataFrame:
    """ST-3, ST-4: work whose key isn't cancelled or paused."""
    return work.join(cancelled.select(*keys).distinct(), keys, "left_anti")


def windows(events: DataFrame, time: str, width: str, slide: str | None = None, delay: str = "10 minutes", keys: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """E-6, ST-9: counts and sums by event-time window, late rows within the delay counted."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = _marked(events, time, delay).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str]) -> DataFrame:
    """E-6: sessions that end after a gap."""
    g = events.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def run_available(stream: DataFrame, sink, checkpoint: str, mode: str = "append"):
    """ST-3, ST-5, ST-7: all that is there now, in micro-batches: sink(DataFrame, batch number)."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return q


class Watcher:
    """ST-8: tells a waiting, complete or failed queue from polled counts (pending, ready, error)."""

    def __init__(self):
        self.state: dict = {}

    def see(self, key, pending: int, ready: int, error: int) -> str | None:
        """The new state if it changed; keys that never had work are silent."""
        was = self.state.get(key)
        now = "waiting" if pending else ("error" if error else "complete" if ready else None)
        if now is None or was is None and now != "waiting" or now == was:
            return None
        self.state[key] = now
        return now


def transitions(polls: DataFrame, keys: list[str], order: str) -> DataFrame:
    """ST-8 over a table of polled counts (pending, ready, error): the rows at which a queue's state changes, as Watcher tells them; nothing before the first wait."""
    state = F.when(F.col("pending") > 0, "waiting").when(F.col("error") > 0, "error").when(F.col("ready") > 0, "complete")
    w = Window.partitionBy(*keys).orderBy(order)
    p = polls.withColumn("state", state).where("state IS NOT NULL")
    p = p.withColumn("_began", F.max((F.col("state") == "waiting").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_began = 1")
    return p.withColumn("_was", F.lag("state").over(w)).where(~F.col("state").eqNullSafe(F.col("_was"))).drop("_began", "_was")
