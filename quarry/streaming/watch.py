"""File events as streams: latest event per path, counters, and continuous indexing by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(events: DataFrame, kind: str = "event_type", at: Column | str = "timestamp") -> DataFrame:
    """path, kind, at: the last event of each path; a burst of events becomes one."""
    at = F.col(at) if isinstance(at, str) else at
    return events.groupBy("path").agg(F.max_by(F.col(kind), at).alias(kind), F.max(at).alias("at"))


def counts(events: DataFrame, kind: str = "event_type") -> DataFrame:
    return events.groupBy(kind).agg(F.count("*").alias("count"))


def start(events: DataFrame, changed: Callable[[DataFrame], None], deleted: Callable[[DataFrame], None], checkpoint: str, debounce: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """Hand each micro-batch's last event per path to `changed` (created, modified) or `deleted`, as DataFrames of path.

    The trigger's interval is the debounce time. A batch that is replayed gives the same calls.
    """

    def handle(batch: DataFrame, _: int) -> None:
        last = latest(batch).persist()
        deleted(last.where("event_type = 'deleted'").select("path"))
        changed(last.where("event_type <> 'deleted'").select("path"))
        last.unpersist()

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()
