"""Queries that run streams to their end: events arrive in files out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.catalogue import ORACLE, _t, query
from tidemark.storage import new_folder
from tidemark.streaming import event_limiter, freshness

_LIMIT, _WINDOW = 3, 86_400_000
_SPANS = 26
_EMPTY_TRIGGERS = "spark.sql.streaming.noDataMicroBatches.enabled"

#: Hits of a user one after another, each with the accepted times of the last day before it.
_LIMITED = """WITH RECURSIVE h AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) // 1000 AS ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
s AS (SELECT key, id, ts_ms, k, [ts_ms] AS kept, true AS accepted, 0 AS retry_after FROM h WHERE k = 1
UNION ALL SELECT key, id, ts_ms, k, CASE WHEN len(f) < 3 THEN list_append(f, ts_ms) ELSE f END, len(f) < 3, CASE WHEN len(f) < 3 THEN 0 ELSE (f[1] + 86400000 - ts_ms + 999) // 1000 END::INT
FROM (SELECT h.*, list_filter(s.kept, lambda x: x >= h.ts_ms - 86400000) AS f FROM s JOIN h ON h.key = s.key AND h.k = s.k + 1))
SELECT {0} FROM s"""

ORACLE["q_rate_limiter"] = _LIMITED.format("id, key, ts_ms, accepted, retry_after")


def _arriving(spark, rows: DataFrame, at_ms: str) -> list[DataFrame]:
    """Rows by weeks of their time, each up to two days late, first week first; a table of more
    than _SPANS weeks by as many longer spans."""
    staged, day = new_folder(spark, "staged"), 86_400_000
    first, last = rows.agg(F.min(at_ms), F.max(at_ms)).first()
    width = max(7 * day, -(-((last or 0) - (first or 0)) // _SPANS))
    span = F.floor((F.col(at_ms) + F.pmod(F.xxhash64("id"), F.lit(2 * day))) / width)
    rows.where(F.col(at_ms).isNotNull()).withColumn("span", span).write.partitionBy("span").parquet(staged)
    placed = spark.read.schema(rows.schema.add("span", "long")).parquet(staged)
    spans = [r[0] for r in placed.select("span").distinct().orderBy("span").collect()]
    return [placed.where(F.col("span") == s).drop("span") for s in spans]


def _hits(spark, folder) -> DataFrame:
    return _t(spark, folder, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("id"))


@query(_LIMITED.format("key::VARCHAR AS key, id, ts_ms, accepted, retry_after"))
def q_limiter_stream(spark, folder):
    """The limiter in event time over hits out of order; a last hit, long after, lets all others go."""
    hits = _hits(spark, folder)
    last = hits.agg(F.lit("closing").alias("key"), (F.coalesce(F.max("ts_ms"), F.lit(0)) + 10 * _WINDOW).alias("ts_ms"), F.lit(-1).cast("long").alias("id"))
    source, out, state = (new_folder(spark, x) for x in ("arriving", "limited", "limiter-state"))
    arriving, before = [*_arriving(spark, hits, "ts_ms"), last], spark.conf.get(_EMPTY_TRIGGERS)
    try:
        for arrived in arriving:
            # all files of a week are one trigger, for the next one finds the watermark moved on
            arrived.write.mode("append").parquet(source)
            stream = event_limiter.limit_event_stream(spark.readStream.schema(hits.schema).parquet(source), "3 days", _LIMIT, _WINDOW)
            # hits that the watermark has passed go with the next week; after the last hit, a trigger without input lets them go
            spark.conf.set(_EMPTY_TRIGGERS, str(arrived is last).lower())
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_EMPTY_TRIGGERS, before)
    return spark.read.schema(event_limiter.OUTPUT).parquet(out)


@query("WITH k AS (SELECT ['economy-lv', 'property', 'environment-ee', 'other'][1 + (user_id % 4)::INT] || '-' || user_id AS cache_key, ts FROM events) SELECT cache_key, CASE WHEN starts_with(cache_key, 'economy') THEN 30 WHEN starts_with(cache_key, 'environment') THEN 15 ELSE 60 END AS minutes FROM k GROUP BY ALL")
def q_fresh_keys_of_a_stream(spark, folder):
    """Every key once: all results of a key come within its time to live, so the first one stays."""
    kind = F.get(F.array(*map(F.lit, ["economy-lv", "property", "environment-ee", "other"])), (F.col("user_id") % 4).cast("int"))
    # the month's events within ten minutes
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.xxhash64("event_id"), F.lit(600)))
    rows = _t(spark, folder, "events").select(F.concat_ws("-", kind, F.col("user_id").cast("string")).alias("cache_key"), at.alias("fetched_at"))
    source, out, state = (new_folder(spark, x) for x in ("results", "fresh", "fresh-state"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    for running in freshness.write_fresh(stream, out, state, availableNow=True):
        running.awaitTermination()
    return spark.read.schema("cache_key string, minutes int").parquet(out).select("cache_key", "minutes")
