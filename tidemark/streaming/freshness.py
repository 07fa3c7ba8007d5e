"""Freshness of a stream of results: of each cache key one result a time to live.

The state of a key is the event time at which its first result goes stale; Spark drops it as the
watermark passes, so idle keys leave nothing behind. Keys have their time to live by how they
begin (sources.snapshots), and a watermark has one delay, so each time to live is a stream of its
own; ``write_fresh`` starts them all into one folder.

A result is dropped while its key's first one is within the time to live of the newest result of
the stream; one that comes later than the time to live behind the newest is dropped as late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.snapshots import MINUTES, OTHER_MINUTES, ttl_minutes


def fresh_stream(results: DataFrame, minutes: int, key: str = "cache_key", at: str = "fetched_at") -> DataFrame:
    """The first result of each key with this time to live."""
    own = results.where((ttl_minutes(F.col(key)) == minutes) & F.col(at).isNotNull())
    return own.withWatermark(at, f"{minutes} minutes").dropDuplicatesWithinWatermark([key])


def write_fresh(results: DataFrame, path: str, state: str, key: str = "cache_key", at: str = "fetched_at", **trigger) -> list[StreamingQuery]:
    """Starts a stream for each time to live; all append to path, in a folder of minutes each."""
    return [
        fresh_stream(results, m, key, at).writeStream.format("parquet").option("path", f"{path}/minutes={m}").option("checkpointLocation", f"{state}/{m}").outputMode("append").trigger(**(trigger or {"processingTime": "10 seconds"})).start()
        for m in sorted({m for _, m in MINUTES} | {OTHER_MINUTES})
    ]
