"""Windows over the stream of prices: an extension beyond the limiter.

Event times that arrive without a zone are taken as UTC, for watermarks need a zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(rows: DataFrame, ts: str = "ts") -> DataFrame:
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def _stats(grouped) -> DataFrame:
    total = F.sum(F.col("price").cast("decimal(28,2)")).cast("double")
    return grouped.agg(F.count("*").alias("n"), F.min("price").alias("min"), F.max("price").alias("max"), F.try_divide(total, F.count("price")).alias("avg"))


def tumbling(rows: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return _stats(with_event_time(rows).withWatermark("ts", late).groupBy(F.window("ts", width), "zone"))


def sliding(rows: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return _stats(with_event_time(rows).withWatermark("ts", late).groupBy(F.window("ts", width, step), "zone"))


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return _stats(with_event_time(rows).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "zone"))
