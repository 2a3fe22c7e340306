"""Event streams: idempotent capture and profiles that follow, beyond the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import refusal
from .stores import EventLog, ProfileStore


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events of which each client_event_id passes once within the watermark; events without one all pass, those that refusal() names never."""
    keyed = stream.filter(refusal(stream.columns).isNull()).withColumn("_id", F.coalesce("client_event_id", F.concat(F.lit("\0"), F.col("event_id"))))
    return keyed.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["_id"]).drop("_id")


def windowed_counts(stream: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events by type and window; late ones within the delay still count."""
    return stream.withWatermark("timestamp", delay).groupBy(F.window("timestamp", width), "event_type").agg(F.count("*").alias("count"))


def _each(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def captured(stream: DataFrame, log: EventLog, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A stream of events into a log, each once: batches that are replayed add nothing, and an id is answered by its first event however late it comes again."""
    return _each(stream, log.append, checkpoint, trigger)


def keep_profiles(stream: DataFrame, store: ProfileStore, items: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Profiles that follow a stream of events, from new events alone; late ones add in."""
    return _each(stream, lambda batch, number: store.add(batch, items, number), checkpoint, trigger)
